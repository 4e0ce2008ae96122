"""The point reads, dashboard reads and quality checks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import is_kind, moment, rnd, weight
from larkspur.operators import api, evaluation, search, serving
from larkspur.operators.features import Layer

USER, PRODUCT, UNKNOWN = 1, 7, -1
NEIGHBOURS_OF = (1, 2, 3, 5, 8, 13)


def anchor_lookup(layer: Layer, user_id: int = USER, limit: int = 50) -> DataFrame:
    rows = layer.log.where(F.col("user_id") == user_id).groupBy("product_id").agg(F.sum(weight()).cast("long").alias("score"))
    return rows.orderBy(F.desc("score"), "product_id").limit(limit)


def recent_demand(layer: Layer, product_id: int = PRODUCT, weeks: int = 4) -> DataFrame:
    since = moment(layer.context.as_of - timedelta(weeks=weeks))
    rows = layer.log.where((F.col("product_id") == product_id) & (F.col("interaction_timestamp") >= since))
    return rows.agg(F.count("*").alias("events"), F.count_if(is_kind("purchase")).alias("purchases"), F.count_distinct("user_id").alias("users"))


def neighbour_lookup(layer: Layer, products: tuple[int, ...] = NEIGHBOURS_OF, limit: int = 100) -> DataFrame:
    rows = layer.product_similarity.where(F.col("product_a").isin(*products)).groupBy("product_b")
    rows = rows.agg(rnd(F.sum(F.col("similarity_score").cast("decimal(18,6)")), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "product_b").limit(limit)


def purchase_exclusion(layer: Layer, user_id: int = USER) -> DataFrame:
    return layer.log.where((F.col("user_id") == user_id) & is_kind("purchase")).select("product_id").distinct()


def tier_counts(layer: Layer) -> DataFrame:
    return layer.user_profile.groupBy("user_tier").agg(F.count("*").alias("users"))


def user_sample(layer: Layer, tier: str = "warm", limit: int = 400) -> DataFrame:
    return layer.user_profile.where(F.col("user_tier") == tier).select("user_id", "distinct_products").orderBy("user_id").limit(limit)


def user_card(layer: Layer, user_id: int = USER) -> DataFrame:
    info = layer.retail.users.select("user_id", "city", "persona")
    return layer.user_profile.where(F.col("user_id") == user_id).join(info, "user_id").select("user_id", "city", "persona", "user_tier", "distinct_products", "total_interactions", "purchased_products", "distinct_categories")


def category_prefs(layer: Layer, user_id: int = USER) -> DataFrame:
    return layer.user_category_preferences.where(F.col("user_id") == user_id).select("category_name", "category_affinity", "interaction_score", "purchase_count", "preference_rank")


def purchase_history(layer: Layer, user_id: int = USER, limit: int = 40) -> DataFrame:
    """The last order lines, whatever the clock."""
    rows = layer.retail.orders.where(F.col("user_id") == user_id).join(layer.retail.order_items, "order_id").join(layer.retail.products.select("product_id", F.col("name").alias("product_name"), "category_name"), "product_id")
    rows = rows.select("order_id", "product_id", F.col("order_date").cast("date").alias("ordered"), "product_name", "category_name", "quantity", F.col("revenue").cast("double").alias("line_total"))
    return rows.orderBy(F.desc("ordered"), F.desc("order_id"), "product_id").limit(limit)


_CARD = ("product_name", "category_name", "brand", "price", "purchase_count", "view_count", "smoothed_rating", "popularity_score", "demand_tier")


def product_card(layer: Layer, product_id: int = PRODUCT) -> DataFrame:
    return layer.product_popularity.where(F.col("product_id") == product_id).select("product_id", *_CARD, "popularity_global_rank")


def popular_products(layer: Layer, limit: int = 25) -> DataFrame:
    return layer.product_popularity.where("is_active").orderBy("popularity_global_rank").limit(limit).select("product_id", *_CARD)


def dashboard_categories(layer: Layer) -> DataFrame:
    rows = layer.retail.order_items.join(layer.retail.orders.where(F.col("order_date") < moment(layer.context.as_of)), "order_id").join(layer.retail.products, "product_id")
    return rows.groupBy("category_name").agg(F.sum("revenue").cast("double").alias("revenue"), F.count_distinct("order_id").alias("orders"))


def dashboard_months(layer: Layer) -> DataFrame:
    rows = layer.retail.orders.where(F.col("order_date") < moment(layer.context.as_of))
    return rows.groupBy(F.trunc(F.col("order_date").cast("date"), "month").alias("month")).agg(F.sum("total_amount").cast("double").alias("revenue"), F.count("*").alias("orders"))


def pipeline_state(layer: Layer) -> DataFrame:
    counts = {
        "users": layer.retail.users,
        "active_products": layer.retail.products.where("is_active"),
        "interactions": layer.log,
        "similarity_pairs": layer.product_similarity,
    }
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.withColumn("as_of", moment(layer.context.as_of))


def eval_pivot(layer: Layer) -> DataFrame:
    """Metrics by strategy, side by side."""
    names = ("precision", "recall", "hit_rate", "ndcg", "served")
    rows = None
    for strategy in evaluation.STRATEGIES:
        one = evaluation.metrics_by_tier(layer, strategy).where("tier = 'overall'")
        one = one.select("strategy", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", "value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("metric").pivot("strategy", list(evaluation.STRATEGIES)).agg(F.first("value"))


def _violations(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("violations"))


def order_totals(layer: Layer) -> DataFrame:
    """Orders with lines whose total is a cent or more from the sum of their lines."""
    lines = layer.retail.order_items.groupBy("order_id").agg(F.sum("revenue").alias("r"))
    return _violations(layer.retail.orders.join(lines, "order_id").where(F.abs(F.col("total_amount") - F.col("r")) > F.lit("0.01").cast("decimal(3,2)")))


def purchase_has_order_line(layer: Layer) -> DataFrame:
    lines = layer.retail.order_items.join(layer.retail.orders, "order_id").select("user_id", "product_id")
    return _violations(layer.retail.interactions.where(is_kind("purchase")).join(lines, ["user_id", "product_id"], "left_anti"))


def interaction_after_signup(layer: Layer) -> DataFrame:
    return _violations(layer.retail.interactions.join(layer.retail.users, "user_id").where(F.col("interaction_timestamp").cast("date") < F.col("signup_date")))


def similarity_symmetric(layer: Layer) -> DataFrame:
    a, b = layer.product_similarity.alias("a"), layer.product_similarity.alias("b")
    both = a.join(b, (F.col("a.product_a") == F.col("b.product_b")) & (F.col("a.product_b") == F.col("b.product_a")))
    return _violations(both.where(F.col("a.similarity_score") != F.col("b.similarity_score")))


def similarity_range(layer: Layer) -> DataFrame:
    return _violations(layer.product_similarity.where(~F.col("similarity_score").between(0, 1.000001) | ~F.col("jaccard_similarity").between(0, 1)))


def no_self_neighbour(layer: Layer) -> DataFrame:
    return _violations(layer.product_similarity.where("product_a = product_b"))


def support_floor(layer: Layer) -> DataFrame:
    return _violations(layer.product_similarity.where(F.col("common_users") < int(layer.context["min_common_users"])))


def affinity_sums_to_one(layer: Layer) -> DataFrame:
    rows = layer.user_category_preferences.groupBy("user_id").agg(F.sum("category_affinity").alias("s"))
    return _violations(rows.where(F.abs(F.col("s") - 1) > 0.001))


def weights_sum_to_one(layer: Layer) -> DataFrame:
    total = sum(v for k, v in layer.context.settings.items() if k.startswith("weight_"))
    return layer.retail.spark.range(1).select(F.round(F.lit(total), 6).alias("total_weight"))


def owned_leak(layer: Layer) -> DataFrame:
    """Recommended products that the user owns."""
    users = layer.retail.users
    return _violations(serving.recommend(layer, users).join(serving.purchased(layer, users), ["user_id", "product_id"], "left_semi"))


def inactive_served(layer: Layer) -> DataFrame:
    """Recommended products that are not active."""
    rows = serving.recommend(layer, layer.retail.users)
    return _violations(rows.join(layer.retail.products.where("not is_active"), "product_id", "left_semi"))


READS = [
    ("b4_text_search", lambda layer: search.matches(layer, search.SAMPLE_QUERY), "behaviour"),
    ("q_no_owned_leak", owned_leak, "stored"),
    ("q_no_inactive", inactive_served, "stored"),
    ("api_health", api.health, "stored"),
    ("api_recommendations", lambda layer: api.recommendations(layer, USER), "stored"),
    ("api_recommendations_unknown", lambda layer: api.recommendations(layer, UNKNOWN), "stored"),
    ("api_similar", lambda layer: api.similar_products(layer, PRODUCT), "stored"),
    ("api_search", lambda layer: api.search_products(layer, search.SAMPLE_QUERY), "stored"),
    ("b1_anchor_lookup", anchor_lookup, "behaviour"),
    ("b2_recent_demand", recent_demand, "behaviour"),
    ("b3_neighbour_lookup", neighbour_lookup, "stored"),
    ("b5_purchase_exclusion", purchase_exclusion, "behaviour"),
    ("d_tier_counts", tier_counts, "stored"),
    ("d_user_sample", user_sample, "stored"),
    ("d_user_profile", user_card, "stored"),
    ("d_category_prefs", category_prefs, "stored"),
    ("d_purchase_history", purchase_history, "behaviour"),
    ("d_product_card", product_card, "stored"),
    ("d_popular_products", popular_products, "stored"),
    ("d_revenue_by_category", dashboard_categories, "ledger"),
    ("d_monthly_revenue", dashboard_months, "ledger"),
    ("d_pipeline_state", pipeline_state, "stored"),
    ("d_eval_pivot", eval_pivot, "stored replay"),
    ("q_order_totals", order_totals, "ledger"),
    ("q_purchase_has_order_line", purchase_has_order_line, "behaviour"),
    ("q_interaction_after_signup", interaction_after_signup, "behaviour"),
    ("q_weights_sum_to_one", weights_sum_to_one, "behaviour"),
    ("q_similarity_symmetric", similarity_symmetric, "stored"),
    ("q_similarity_range", similarity_range, "stored"),
    ("q_no_self_neighbour", no_self_neighbour, "stored"),
    ("q_support_floor", support_floor, "stored"),
    ("q_affinity_sums_to_one", affinity_sums_to_one, "stored"),
]
