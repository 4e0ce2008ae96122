"""The twenty-five analytical queries, each a function of the retail relations.

Floors and bounds are parameters; their defaults fit the driver's tables. Every
order that feeds a limit, a rank or a running sum ends in a unique key.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.context import FUNNEL
from larkspur.functions.exprs import age_days, div, is_kind, moment, month, month_index, pct, rnd
from larkspur.functions.places import medians, rank_threshold
from larkspur.operators.features import Layer


def _dbl(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _orders(layer: Layer) -> DataFrame:
    return layer.retail.orders.where(F.col("order_date") < moment(layer.context.as_of))


def _lines(layer: Layer, *info: str) -> DataFrame:
    rows = layer.retail.order_items.join(_orders(layer).select("order_id", "user_id", "order_date"), "order_id")
    return rows.join(layer.retail.products.select("product_id", *info), "product_id") if info else rows


def _log(layer: Layer, *info: str) -> DataFrame:
    return layer.log.join(layer.retail.products.select("product_id", *info), "product_id")


def top_products_revenue(layer: Layer, limit: int = 25) -> DataFrame:
    rows = _lines(layer, "name", "category_name", "brand").groupBy("product_id", F.col("name").alias("product_name"), "category_name", "brand")
    rows = rows.agg(F.count_distinct("order_id").alias("orders"), F.sum("quantity").alias("units_sold"), _dbl(F.sum("revenue")).alias("revenue"), rnd(F.avg("unit_price"), 2).alias("average_selling_price"))
    rows = rows.withColumn("pct_of_total_revenue", pct("revenue", _dbl(F.sum(F.col("revenue").cast("decimal(18,2)")).over(W.partitionBy())), 3))
    return rows.orderBy(F.desc("revenue"), "product_id").limit(limit)


def revenue_by_category(layer: Layer) -> DataFrame:
    rows = _lines(layer, "category_name").groupBy("category_name").agg(F.count_distinct("order_id").alias("orders"), F.count_distinct("user_id").alias("customers"), F.sum("revenue").alias("r"))
    return rows.select("category_name", "orders", "customers", _dbl("r").alias("revenue"), pct("r", _dbl(F.sum("r").over(W.partitionBy()))).alias("pct_of_revenue"), F.rank().over(W.orderBy(F.desc("r"))).alias("revenue_rank"))


def monthly_revenue(layer: Layer) -> DataFrame:
    rows = _orders(layer).groupBy(month("order_date").alias("month")).agg(F.count("*").alias("orders"), F.count_distinct("user_id").alias("active_customers"), F.sum("total_amount").alias("r"))
    w = W.orderBy("month")
    last = F.lag("r").over(w)
    return rows.select(
        "month",
        "orders",
        "active_customers",
        _dbl("r").alias("revenue"),
        _dbl(last).alias("previous_month_revenue"),
        pct(F.col("r") - last, last).alias("growth_pct"),
        _dbl(F.lead("r").over(w)).alias("next_month_revenue"),
        _dbl(F.sum("r").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("cumulative_revenue"),
        rnd(div(F.sum("r").over(w.rowsBetween(-2, 0)), F.count("r").over(w.rowsBetween(-2, 0))), 2).alias("three_month_average"),
    )


def average_order_value(layer: Layer) -> DataFrame:
    units = layer.retail.order_items.groupBy("order_id").agg(F.sum("quantity").alias("units"))
    rows = _orders(layer).join(units, "order_id", "left").groupBy(month("order_date").alias("month"))
    rows = rows.agg(F.count("*").alias("orders"), F.sum("total_amount").alias("r"), rnd(div(F.sum("units"), F.count("units")), 2).alias("average_basket_size"))
    middle = medians(_orders(layer).select(month("order_date").alias("month"), "total_amount"), "month", "total_amount")
    rows = rows.join(middle.withColumnRenamed("median", "m"), "month", "left")
    value = div("r", "orders")
    return rows.select("month", "orders", rnd(value, 2).alias("average_order_value"), rnd("m", 2).alias("median_order_value"), "average_basket_size", rnd(F.avg(value).over(W.partitionBy()), 2).alias("average_across_all_months"))


def customer_ltv(layer: Layer, limit: int = 50) -> DataFrame:
    """The most valuable customers. Their places among all follow from their places
    in the list and from counts, so no window holds all customers."""
    rows = _orders(layer).join(layer.retail.users.select("user_id", "city"), "user_id").groupBy("user_id", "city")
    rows = rows.agg(F.count_distinct("order_id").alias("orders"), F.sum("total_amount").alias("r"), F.min("order_date").cast("date").alias("first_order"), F.max("order_date").cast("date").alias("last_order"), F.count("*").alias("n"))
    top = rows.orderBy(F.desc("r"), "user_id").limit(limit)
    every = rows.agg(F.count("*").alias("all"))
    ties = rows.join(F.broadcast(top.select("r").distinct()), "r").groupBy("r").agg(F.count("*").alias("ties"))  # limit values
    top = top.join(F.broadcast(ties), "r").crossJoin(F.broadcast(every))
    place, rank = F.row_number().over(W.orderBy(F.desc("r"), "user_id")), F.rank().over(W.orderBy(F.desc("r")))
    smaller = F.col("all") - (rank - 1) - F.col("ties")
    small, extra = F.floor(F.col("all") / 10), F.col("all") % 10
    early = extra * (small + 1)
    decile = F.when(place <= early, F.ceil(place / (small + 1))).otherwise(extra + F.ceil((place - early) / F.greatest(small, F.lit(1))))
    return top.select(
        "user_id",
        "city",
        "orders",
        _dbl("r").alias("lifetime_value"),
        rnd(div("r", "n"), 2).alias("average_order_value"),
        "first_order",
        "last_order",
        F.datediff("last_order", "first_order").alias("customer_lifespan_days"),
        decile.cast("int").alias("value_decile"),
        rnd(F.coalesce(div(smaller, F.col("all") - 1), F.lit(0.0)), 4).alias("value_percentile"),
    ).orderBy(F.desc("lifetime_value"), "user_id")


def repeat_purchase_rate(layer: Layer) -> DataFrame:
    """By the category of the largest line of a customer's first order."""
    per = _orders(layer).groupBy("user_id").agg(F.count("*").alias("total_orders"), F.min_by("order_id", F.struct("order_date", "order_id")).alias("order_id"))
    lines = layer.retail.order_items.join(layer.retail.products.select("product_id", "category_name"), "product_id")
    first = per.join(lines, "order_id").groupBy("user_id", "total_orders").agg(F.max_by("category_name", F.struct("revenue", -F.col("product_id"))).alias("acquisition_category"))
    again = F.count_if(F.col("total_orders") >= 2)
    return first.groupBy("acquisition_category").agg(F.count("*").alias("customers"), again.alias("repeat_customers"), pct(again, F.count("*")).alias("repeat_rate_pct"), rnd(F.avg("total_orders"), 2).alias("average_orders_per_customer"))


#: The frequency bands, by their greatest number of orders.
BANDS = ((1, "01 order"), (2, "02 orders"), (5, "03 to 05 orders"), (10, "06 to 10 orders"), (20, "11 to 20 orders"))


def purchase_frequency(layer: Layer) -> DataFrame:
    band = F.lit("21 or more orders")
    for top, name in reversed(BANDS):
        band = F.when(F.col("orders") <= top, name).otherwise(band)
    rows = _orders(layer).groupBy("user_id").agg(F.count("*").alias("orders")).groupBy(band.alias("frequency_band")).agg(F.count("*").alias("customers"), F.sum("orders").alias("total_orders"))
    total = F.sum("customers").over(W.partitionBy())
    running = F.sum("customers").over(W.orderBy("frequency_band").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("frequency_band", "customers", "total_orders", pct("customers", total).alias("pct_of_customers"), pct("total_orders", F.sum("total_orders").over(W.partitionBy())).alias("pct_of_orders"), pct(running, total).alias("cumulative_pct_customers"))


def most_viewed(layer: Layer, limit: int = 25) -> DataFrame:
    rows = _log(layer, "name", "category_name").groupBy("product_id", F.col("name").alias("product_name"), "category_name")
    rows = rows.agg(F.count_if(is_kind("view")).alias("views"), F.count_distinct(F.when(is_kind("view"), F.col("user_id"))).alias("unique_viewers"), F.count_if(is_kind("cart")).alias("carts"), F.count_if(is_kind("purchase")).alias("purchases"))
    return rows.withColumn("views_per_viewer", rnd(div("views", "unique_viewers"), 2)).orderBy(F.desc("views"), "product_id").limit(limit)


def highest_converting(layer: Layer, least_views: int = 200, limit: int = 25) -> DataFrame:
    rows = _log(layer, "name", "category_name", "price").groupBy("product_id", F.col("name").alias("product_name"), "category_name", "price")
    rows = rows.agg(*(F.count_if(is_kind(k)).alias(f"{k}s") for k in ("view", "cart", "purchase"))).where(F.col("views") >= least_views)
    rows = rows.withColumns({"view_to_cart_pct": pct("carts", "views"), "cart_to_purchase_pct": pct("purchases", "carts"), "view_to_purchase_pct": pct("purchases", "views")})
    return rows.orderBy(F.desc("view_to_purchase_pct"), "product_id").limit(limit)


def trending_products(layer: Layer, weeks: int = 4, least_events: int = 50, limit: int = 25) -> DataFrame:
    """A span against the span before it, both counted in one pass."""
    at, ts = layer.context.as_of, F.col("interaction_timestamp")
    middle, start = moment(at - timedelta(weeks=weeks)), moment(at - timedelta(weeks=2 * weeks))
    rows = layer.log.where(ts >= start).groupBy("product_id")
    rows = rows.agg(F.count_if(ts >= middle).alias("recent_events"), F.count_if(ts < middle).alias("prior_events"), F.count_if((ts >= middle) & is_kind("purchase")).alias("recent_purchases"))
    now, old = F.col("recent_events"), F.col("prior_events")
    label = F.when(old == 0, "newly discovered").when(now > old * 1.5, "surging").when(now > old * 1.1, "rising").when(now < old * 0.7, "cooling").otherwise("steady")
    rows = rows.where(now >= least_events).join(layer.retail.products.select("product_id", F.col("name").alias("product_name"), "category_name"), "product_id")
    rows = rows.select("product_id", "product_name", "category_name", "prior_events", "recent_events", "recent_purchases", rnd(div(now, old), 3).alias("growth_multiple"), label.alias("trend_label"))
    return rows.orderBy(F.desc_nulls_last("growth_multiple"), F.desc("recent_events"), "product_id").limit(limit)


def favourite_categories(layer: Layer, limit: int = 50) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("interaction_score"), "category_id"))
    rows = layer.user_category_preferences.withColumn("place", place)

    def at(k: int, name: str) -> Column:
        return F.max(F.when(F.col("place") == k, F.col(name)))

    out = rows.groupBy("user_id").agg(at(1, "category_name").alias("favourite_category"), at(1, "interaction_score").alias("favourite_score"), at(2, "category_name").alias("second_category"), at(2, "interaction_score").alias("second_score"), at(3, "category_name").alias("third_category"), F.sum("interaction_score").alias("total"))
    out = out.join(layer.retail.users.select("user_id", F.col("persona").alias("generated_persona")), "user_id")
    return out.withColumn("favourite_concentration", rnd(div("favourite_score", "total"), 3)).drop("total").orderBy("user_id").limit(limit)


def market_basket(layer: Layer, least_baskets: int = 10, limit: int = 25) -> DataFrame:
    basket = _lines(layer).select("order_id", "product_id")
    alone = basket.groupBy("product_id").agg(F.count("*").alias("baskets"))
    total = basket.agg(F.count_distinct("order_id").alias("total"))
    a, b = basket.alias("a"), basket.alias("b")
    pairs = a.join(b, (F.col("a.order_id") == F.col("b.order_id")) & (F.col("a.product_id") < F.col("b.product_id")))
    pairs = pairs.groupBy(F.col("a.product_id").alias("ia"), F.col("b.product_id").alias("ib")).agg(F.count("*").alias("baskets_together")).where(F.col("baskets_together") >= least_baskets)
    info = layer.retail.products.select("product_id", "name", "category_name").join(alone, "product_id")
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("product_id").alias(f"i{side}"), F.col("name").alias(f"product_{side}"), F.col("category_name").alias(f"category_{side}"), F.col("baskets").alias(f"n{side}")), f"i{side}")
    pairs = pairs.crossJoin(F.broadcast(total))
    together, both = _dbl("baskets_together"), F.col("na") * F.col("nb")
    rows = pairs.withColumns(
        {
            "support_pct": pct("baskets_together", "total", 4),
            "confidence_a_to_b_pct": pct("baskets_together", "na"),
            "confidence_b_to_a_pct": pct("baskets_together", "nb"),
            "lift": rnd(div(together * F.col("total"), both), 2),
        }
    ).orderBy(F.desc("lift"), F.desc("baskets_together"), "ia", "ib")
    return rows.limit(limit).select(F.col("ia").alias("product_a_id"), F.col("ib").alias("product_b_id"), "product_a", "product_b", "category_a", "category_b", "baskets_together", "support_pct", "confidence_a_to_b_pct", "confidence_b_to_a_pct", "lift")


def _best_seller(layer: Layer, category: str | None = None, linked: bool = False) -> DataFrame:
    """The best seller of all products or of a category; ``linked``: of those with neighbours."""
    rows = _lines(layer, "category_name")
    if linked:
        rows = rows.join(layer.product_similarity.select(F.col("product_a").alias("product_id")).distinct(), "product_id", "left_semi")
    if category is not None:
        rows = rows.where(F.col("category_name") == category)
    return rows.groupBy("product_id").agg(F.sum("revenue").alias("r")).orderBy(F.desc("r"), "product_id").limit(1).select("product_id")


def top_seller_neighbours(layer: Layer, category: str | None = None, limit: int = 15, linked: bool = False) -> DataFrame:
    label = F.when(F.col("same_subcategory"), "substitute").when(F.col("same_category"), "complement in the same aisle").otherwise("cross category affinity")
    names = layer.retail.products
    rows = layer.product_similarity.join(F.broadcast(_best_seller(layer, category, linked).withColumnRenamed("product_id", "product_a")), "product_a")
    rows = rows.join(names.select(F.col("product_id").alias("product_a"), F.col("name").alias("source_product")), "product_a").join(names.select(F.col("product_id").alias("product_b"), F.col("name").alias("neighbour"), "category_name", "subcategory"), "product_b")
    rows = rows.withColumn("relationship", label).orderBy(F.desc("cosine_similarity"), "product_b").limit(limit)
    return rows.select("source_product", "neighbour", "category_name", "subcategory", "common_users", "cosine_similarity", "jaccard_similarity", "neighbour_rank", "relationship")


def bought_x_not_y(layer: Layer, category: str | None = None, limit: int = 25, linked: bool = False) -> DataFrame:
    """Buyers of the best seller who lack its nearest neighbour; none if it has no neighbour."""
    x = _best_seller(layer, category, linked)
    near = layer.product_similarity.join(F.broadcast(x.withColumnRenamed("product_id", "product_a")), "product_a").orderBy(F.desc("similarity_score"), "product_b").limit(1).select(F.col("product_b").alias("product_id"))
    name = layer.retail.products.select("product_id", "name")
    lines = _lines(layer)
    lacking = lines.join(F.broadcast(near), "product_id", "left_semi").select("user_id")
    rows = lines.join(F.broadcast(x.join(name, "product_id").withColumnRenamed("name", "bought_this")), "product_id").join(lacking, "user_id", "left_anti")
    rows = rows.groupBy("user_id", "bought_this").agg(F.count_distinct("order_id").alias("orders_with_anchor"), _dbl(F.sum("revenue")).alias("spend_on_anchor"))
    not_this = F.broadcast(near.join(name, "product_id").select(F.col("name").alias("but_not_this")))  # one row
    rows = rows.crossJoin(not_this).join(layer.retail.users.select("user_id", "city"), "user_id")
    return rows.select("bought_this", "but_not_this", "user_id", "city", "orders_with_anchor", "spend_on_anchor").orderBy(F.desc("spend_on_anchor"), "user_id").limit(limit)


def consecutive_months(layer: Layer, least: int = 3, limit: int = 25) -> DataFrame:
    """Streaks of months with an order, and the revenue in them.

    A month's revenue is summed before the streaks are found, so no range join is needed.
    """
    per = _orders(layer).groupBy("user_id", month("order_date").alias("m")).agg(F.sum("total_amount").alias("r"))
    island = month_index(F.col("m")) - F.row_number().over(W.partitionBy("user_id").orderBy("m"))
    rows = per.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("consecutive_months"), F.min("m").alias("streak_start"), F.max("m").alias("streak_end"), _dbl(F.sum("r")).alias("revenue_during_streak"))
    rows = rows.where(F.col("consecutive_months") >= least).join(layer.retail.users.select("user_id", "city"), "user_id").drop("island")
    return rows.orderBy(F.desc("consecutive_months"), F.desc("revenue_during_streak"), "user_id", "streak_start").limit(limit)


def cohort_retention(layer: Layer, months: int = 12, limit: int = 100) -> DataFrame:
    users = layer.retail.users.select("user_id", F.trunc("signup_date", "month").alias("cohort_month"))
    size = users.groupBy("cohort_month").agg(F.count("*").alias("cohort_users"))
    grid = size.withColumn("month_offset", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    offset = month_index(F.col("order_date")) - month_index(F.col("cohort_month"))
    active = _orders(layer).join(users, "user_id").groupBy("cohort_month", offset.alias("month_offset")).agg(F.count_distinct("user_id").alias("n"))
    rows = grid.join(active, ["cohort_month", "month_offset"], "left").withColumn("active_users", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return rows.withColumn("retention_pct", pct("active_users", "cohort_users")).orderBy("cohort_month", "month_offset").limit(limit)


def rank_in_category(layer: Layer, limit: int = 200) -> DataFrame:
    rows = _lines(layer, "name", "category_id", "category_name", "brand").groupBy("product_id", F.col("name").alias("product_name"), "category_id", "category_name", "brand").agg(F.sum("revenue").alias("r"), F.sum("quantity").alias("units"))
    aisle = W.partitionBy("category_id")
    by_units = aisle.orderBy(F.desc("units"))
    rows = rows.select("category_name", "product_id", "product_name", "brand", _dbl("r").alias("revenue"), "units", F.row_number().over(aisle.orderBy(F.desc("r"), "product_id")).alias("row_number_in_category"), F.rank().over(by_units).alias("rank_by_units"), F.dense_rank().over(by_units).alias("dense_rank_by_units"), pct("r", _dbl(F.sum("r").over(aisle))).alias("pct_of_category_revenue"))
    return rows.orderBy("category_name", F.desc("revenue"), "product_id").limit(limit)


def pareto(layer: Layer, limit: int = 100) -> DataFrame:
    rows = _lines(layer, "name", "category_name").groupBy("product_id", F.col("name").alias("product_name"), "category_name").agg(F.sum("revenue").alias("r"))
    whole = rows.agg(_dbl(F.sum("r")).alias("total"), F.count("*").alias("all"))
    top = rows.orderBy(F.desc("r"), "product_id").limit(limit).crossJoin(F.broadcast(whole))
    most = W.orderBy(F.desc("r"), "product_id")  # of the list alone
    place, running = F.row_number().over(most), F.sum("r").over(most.rowsBetween(W.unboundedPreceding, 0))
    top = top.select(place.alias("revenue_rank"), "product_id", "product_name", "category_name", _dbl("r").alias("revenue"), pct("r", "total", 4).alias("pct_of_revenue"), pct(running, "total").alias("cumulative_pct_of_revenue"), pct(place, "all").alias("cumulative_pct_of_catalogue"))
    return top.orderBy("revenue_rank")


def top_decile_customers(layer: Layer, percentile: float = 0.90) -> DataFrame:
    rows = _orders(layer).groupBy("user_id").agg(F.count_distinct("order_id").alias("orders"), F.sum("total_amount").alias("r"))
    least = rank_threshold(rows, "r", percentile)
    rows = rows.crossJoin(F.broadcast(least)).withColumn("in", F.col("r") >= F.col("least"))
    top = lambda x: F.sum(F.when(F.col("in"), x))
    n = F.count_if("in")
    return rows.agg(n.alias("top_decile_customers"), _dbl(top(F.col("r"))).alias("top_decile_revenue"), pct(top(F.col("r")), F.sum("r")).alias("pct_of_all_revenue"), rnd(div(top(F.col("r")), n), 2).alias("average_revenue_per_customer"), rnd(div(top(F.col("orders")), n), 2).alias("average_orders_per_customer"))


def conversion_funnel(layer: Layer) -> DataFrame:
    stage = F.lit(None).cast("int")
    for kind, (_, place) in FUNNEL.items():
        stage = F.when(is_kind(kind), F.lit(place)).otherwise(stage)
    rows = layer.log.groupBy(stage.alias("funnel_stage"), "interaction_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("product_id").alias("products"))
    w = W.orderBy("funnel_stage")
    before = F.lag("events").over(w)
    return rows.withColumns({"previous_stage_events": before, "stage_conversion_pct": pct("events", before), "pct_of_top_of_funnel": pct("events", F.first_value("events").over(w))})


def category_crossover(layer: Layer) -> DataFrame:
    who = _lines(layer, "category_id", "category_name").select("user_id", "category_id", "category_name").distinct()
    size = who.groupBy("category_id").agg(F.count("*").alias("n"))
    a, b = who.alias("a"), who.alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.category_id") < F.col("b.category_id")))
    both = both.groupBy(F.col("a.category_id").alias("ia"), F.col("b.category_id").alias("ib"), F.col("a.category_name").alias("category_a"), F.col("b.category_name").alias("category_b")).agg(F.count("*").alias("shared_customers"))
    for side in ("a", "b"):
        both = both.join(F.broadcast(size.select(F.col("category_id").alias(f"i{side}"), F.col("n").alias(f"n{side}"))), f"i{side}")
    union = F.col("na") + F.col("nb") - F.col("shared_customers")
    return both.select("category_a", "category_b", "shared_customers", pct("shared_customers", "na").alias("pct_of_a_who_also_buy_b"), pct("shared_customers", "nb").alias("pct_of_b_who_also_buy_a"), rnd(div("shared_customers", union), 4).alias("jaccard_overlap"))


def price_bands(layer: Layer, low: float = 5.0, high: float = 2600.0, bands: int = 6) -> DataFrame:
    """Bands of the logarithm of the price. All order lines count, whatever the clock, as in the model."""
    sold = layer.retail.order_items.groupBy("product_id").agg(F.sum("quantity").alias("q"), F.sum("revenue").alias("r"))
    band = F.width_bucket(F.ln("price"), F.ln(F.lit(low)), F.ln(F.lit(high)), F.lit(bands))
    rows = layer.retail.products.select("product_id", "price").join(sold, "product_id", "left").groupBy(band.cast("int").alias("price_band"))
    rows = rows.agg(rnd(F.min("price"), 2).alias("band_min_price"), rnd(F.max("price"), 2).alias("band_max_price"), F.count_distinct("product_id").alias("products"), F.coalesce(F.sum("q"), F.lit(0)).alias("units_sold"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    return rows.withColumns({"revenue": _dbl("r"), "pct_of_revenue": pct("r", _dbl(F.sum("r").over(W.partitionBy())))}).drop("r")


def brand_performance(layer: Layer) -> DataFrame:
    stars = layer.retail.ratings.groupBy("product_id").agg(F.avg("rating").alias("stars"))
    rows = _lines(layer, "category_name", "brand").join(stars, "product_id", "left").groupBy("category_name", "brand")
    rows = rows.agg(F.count_distinct("product_id").alias("products"), F.count_distinct("user_id").alias("customers"), F.sum("revenue").alias("r"), rnd(F.avg(F.coalesce("stars", F.lit(3.5))), 2).alias("average_rating"))
    aisle = W.partitionBy("category_name")
    mean = div(F.sum("r").over(aisle), F.count("*").over(aisle))
    return rows.select("category_name", "brand", "products", "customers", _dbl("r").alias("revenue"), "average_rating", F.rank().over(aisle.orderBy(F.desc("r"))).alias("rank_in_category"), pct("r", _dbl(F.sum("r").over(aisle))).alias("share_of_category_pct"), rnd(_dbl("r") - mean, 2).alias("revenue_vs_category_average"))


def new_vs_returning(layer: Layer) -> DataFrame:
    first = F.min("order_date").over(W.partitionBy("user_id"))
    rows = _orders(layer).withColumn("new", F.col("order_date") == first)
    returning = F.sum(F.when(~F.col("new"), F.col("total_amount")))
    return rows.groupBy(month("order_date").alias("month")).agg(
        F.count_if("new").alias("acquisition_orders"),
        F.count_if(~F.col("new")).alias("returning_orders"),
        _dbl(F.sum(F.when(F.col("new"), F.col("total_amount")))).alias("acquisition_revenue"),
        _dbl(returning).alias("returning_revenue"),
        pct(returning, F.sum("total_amount")).alias("pct_revenue_from_returning"),
    )


def order_cadence(layer: Layer, least_gaps: int = 4, limit: int = 25) -> DataFrame:
    gap = F.datediff("order_date", F.lag("order_date").over(W.partitionBy("user_id").orderBy("order_date", "order_id")))
    rows = _orders(layer).withColumn("gap", gap).groupBy("user_id").agg(F.count("gap").alias("gaps"), rnd(F.avg("gap"), 1).alias("average_gap_days"), rnd(F.stddev_samp("gap"), 1).alias("gap_stddev"), F.max("order_date").alias("last"))
    idle = F.floor(age_days(F.col("last"), layer.context.as_of)).cast("int")
    rows = rows.where(F.col("gaps") >= least_gaps).withColumn("days_since_last_order", idle).join(layer.retail.users.select("user_id", "city"), "user_id")
    mean, days = F.col("average_gap_days"), F.col("days_since_last_order")
    signal = F.when(days > mean * 3, "at risk").when(days > mean * 2, "slipping").otherwise("on cadence")
    rows = rows.select("user_id", "city", (F.col("gaps") + 1).alias("orders"), "average_gap_days", "gap_stddev", F.col("last").cast("date").alias("last_order"), "days_since_last_order", rnd(div(days, mean), 2).alias("cadence_multiple"), signal.alias("churn_signal"))
    return rows.orderBy(F.desc_nulls_first("cadence_multiple"), "user_id").limit(limit)


#: (name, function, clock): which clock bounds each query.
#: Where the test tables are smaller than the model's, the floors are lower and the
#: bands narrower than the defaults.
ANALYTICS = [
    ("a01_top_products_revenue", top_products_revenue, "ledger"),
    ("a02_revenue_by_category", revenue_by_category, "ledger"),
    ("a03_monthly_revenue", monthly_revenue, "ledger"),
    ("a04_average_order_value", average_order_value, "ledger"),
    ("a05_customer_ltv", customer_ltv, "ledger"),
    ("a06_repeat_purchase_rate", repeat_purchase_rate, "ledger"),
    ("a07_purchase_frequency", purchase_frequency, "ledger"),
    ("a08_most_viewed", most_viewed, "behaviour"),
    ("a09_highest_converting", lambda layer: highest_converting(layer, least_views=10), "behaviour"),
    ("a10_trending_4w", lambda layer: trending_products(layer, least_events=20), "behaviour"),
    ("a11_favourite_categories", favourite_categories, "behaviour"),
    ("a12_market_basket", lambda layer: market_basket(layer, least_baskets=2), "ledger"),
    ("a13_top_seller_neighbours", lambda layer: top_seller_neighbours(layer, linked=True), "stored"),
    ("a14_bought_x_not_y", lambda layer: bought_x_not_y(layer, linked=True), "stored"),
    ("a15_consecutive_months", consecutive_months, "ledger"),
    ("a16_cohort_retention", cohort_retention, "ledger"),
    ("a17_rank_in_category", rank_in_category, "ledger"),
    ("a18_pareto", pareto, "ledger"),
    ("a19_top_decile_customers", top_decile_customers, "ledger"),
    ("a20_conversion_funnel", conversion_funnel, "behaviour"),
    ("a21_category_crossover", category_crossover, "ledger"),
    ("a22_price_bands", lambda layer: price_bands(layer, 900.0, 1000.0), "ledger"),
    ("a23_brand_performance", brand_performance, "ledger"),
    ("a24_new_vs_returning", new_vs_returning, "ledger"),
    ("a25_order_cadence", order_cadence, "ledger"),
]
