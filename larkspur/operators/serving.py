"""Batched serving: trending, personalised and similar products.

Every operator takes a relation of users (or products) and serves all of them
in one plan; windows are per user, so nothing of one request meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.exprs import div, minmax, moment, rnd
from larkspur.operators.features import Layer
from larkspur.sources.files import written

#: Fixed values of candidate generation.
TOP_CATEGORIES, CATEGORY_DEPTH, TRENDING_POOL = 3, 25, 200


def trending(layer: Layer, limit: int = 10) -> DataFrame:
    """Active products by popularity x momentum x rating."""
    rows = layer.product_popularity.where("is_active").join(layer.product_trend.select("product_id", "momentum", "trend_direction"), "product_id", "left")
    score = F.col("popularity_score") * F.coalesce("momentum", F.lit(1.0)) * (F.col("smoothed_rating") / 5.0)
    rows = rows.select("product_id", "product_name", F.col("category_name").alias("category"), "price", rnd(score, 6).alias("trending_score"), F.coalesce("trend_direction", F.lit("steady")).alias("trend_direction"))
    return rows.orderBy(F.desc("trending_score"), "product_id").limit(limit)


def anchors(layer: Layer, users: DataFrame, cap: int) -> DataFrame:
    """A user's strongest products, with their share of the strength of those kept."""
    user = W.partitionBy("user_id")
    rows = layer.user_product_features.where("decayed_score > 0").join(users.select("user_id"), "user_id", "left_semi")
    rows = rows.withColumn("k", F.row_number().over(user.orderBy(F.desc("decayed_score"), "product_id"))).where(F.col("k") <= cap)
    share = div("decayed_score", F.sum(F.col("decayed_score").cast("decimal(18,4)")).over(user))
    return rows.select("user_id", F.col("product_id").alias("anchor"), share.alias("anchor_weight"))


def collaborative(layer: Layer, users: DataFrame, cap: int) -> DataFrame:
    """Neighbours of a user's anchors: summed score, supporting anchors, strongest anchor."""
    sim = layer.product_similarity.select(F.col("product_a").alias("anchor"), F.col("product_b").alias("product_id"), "similarity_score", "common_users")
    part = F.col("similarity_score") * F.col("anchor_weight")
    return anchors(layer, users, cap).join(sim, "anchor").groupBy("user_id", "product_id").agg(
        F.sum(part).alias("cf_score"),
        F.count("*").alias("supporting_anchors"),
        F.max_by("anchor", F.struct(part, -F.col("anchor"))).alias("top_anchor"),
    )


def purchased(layer: Layer, users: DataFrame) -> DataFrame:
    """Distinct (user, product) bought, in the log or in the ledger."""
    log = layer.user_product_features.where("has_purchased").select("user_id", "product_id")
    before = layer.retail.orders.where(F.col("order_date") < moment(layer.context.as_of)).select("order_id", "user_id")
    ledger = layer.retail.order_lines.join(before, "order_id").select("user_id", "product_id")
    return log.union(ledger).join(users.select("user_id"), "user_id", "left_semi").distinct()


#: From this weight on, a step of the rating (4 places, a range of 5 at most) moves
#: a score by more than its rounding to 6 places.
RATING_DECIDES = 0.05


def _shelves(pop: DataFrame, limit: int, decides: bool) -> DataFrame:
    """category_id, product_id, reach: the products that a category offers.

    A rank with ties may hold the whole category, of which few can be served. For
    a user, products of one category differ only in popularity, rating and
    recency. Of those equal in popularity and recency the better rated come
    first, so only the first ``limit`` of each such group can be served, and a
    later one if as many of its category are owned. The least and greatest of each
    signal stay too, as they set the scale. ``reach`` is how many owned products it takes.
    """
    shelf = pop.where(F.col("popularity_category_rank") <= CATEGORY_DEPTH)
    aisle = W.partitionBy("category_id")
    alike = W.partitionBy("category_id", "popularity_score", "recency_score").orderBy(F.desc("smoothed_rating"), "product_id")
    places = [F.row_number().over(alike) - limit] if decides else [F.lit(0)]
    for signal in ("popularity_score", "smoothed_rating", "recency_score"):
        places += [F.row_number().over(aisle.orderBy(way(signal), "product_id")) - 1 for way in (F.asc, F.desc)]
    return shelf.select("category_id", "product_id", F.greatest(F.least(*places), F.lit(0)).alias("reach"))


def _reason(c) -> Column:
    sim, aff, pop = (F.col("n_sim") >= c["reason_similarity_cut"], F.col("n_cat") >= c["reason_affinity_cut"], F.col("n_pop") >= c["reason_popularity_cut"])
    name = F.coalesce("anchor_name", F.lit(""))
    rank, aisle = F.col("popularity_category_rank").cast("string"), F.col("category")
    more = (F.col("supporting_anchors") - 1).cast("string")
    return (
        F.when(sim & (F.col("supporting_anchors") >= 3), F.concat(F.lit("Customers who bought "), name, F.lit(" also bought this, and "), more, F.lit(" other items in your history point to it")))
        .when(sim, F.concat(F.lit("Similar to "), name, F.lit(", which you already engaged with")))
        .when(aff & (F.col("preference_rank") == 1), F.concat(F.lit("Number "), rank, F.lit(" in "), aisle, F.lit(", the category you shop most")))
        .when(aff, F.concat(F.lit("Number "), rank, F.lit(" in "), aisle, F.lit(", a category you shop regularly")))
        .when(pop & (F.col("momentum") > 1.2), "Trending right now across the store")
        .when(pop, "Currently popular across the store")
        .when(F.col("cf_score") > 0, "Recommended based on your recent activity")
        .otherwise("Highly rated pick to get you started")
    )


def recommend(layer: Layer, users: DataFrame, limit: int = 10) -> DataFrame:
    """Personalised shelves of ``limit`` products for all ``users`` (user_id).

    Three candidate sources, exclusion of what a user owns, min-max scaling of
    five signals within a user's candidates, weighted blend, rank and reason.
    A user who is left with no candidate gets trending products they don't own.

    Users without any interaction differ only in what they own of the trending
    pool: one of those who own the same is served, for all of them.
    """
    users = users.select("user_id").distinct()
    tiers = users.join(layer.user_profile.select("user_id", "user_tier", "distinct_products"), "user_id", "left")
    tiers = tiers.select("user_id", F.coalesce("user_tier", F.lit("cold")).alias("user_tier"), (F.coalesce("distinct_products", F.lit(0)) == 0).alias("blank"))
    pool = written(trending(layer, TRENDING_POOL), "trending")  # TRENDING_POOL rows
    hot = F.broadcast(pool.select("product_id"))
    owned = written(purchased(layer, users), "owned")
    mine = owned.join(hot, "product_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list("product_id")).alias("own"))
    alike = tiers.join(mine, "user_id", "left").withColumn("own", F.when(F.col("blank"), F.coalesce("own", F.array().cast("array<bigint>"))))
    first = alike.where("blank").groupBy("own").agg(F.min("user_id").alias("one"))
    stands = alike.join(first, "own", "left").select("user_id", "user_tier", F.coalesce("one", "user_id").alias("stand_in"))
    stands = written(stands, "stands")
    ranked = written(_ranked(layer, stands.where("user_id = stand_in").select("user_id", "user_tier"), owned, hot, limit), "ranked")
    each = stands.select(F.col("user_id").alias("like"), "stand_in")
    served = each.join(ranked, F.col("stand_in") == F.col("user_id")).select(F.col("like").alias("user_id"), *ranked.columns[1:])
    unserved = each.join(ranked.select(F.col("user_id").alias("stand_in")).distinct(), "stand_in", "left_anti").select(F.col("like").alias("user_id"))
    wide = unserved.crossJoin(F.broadcast(pool)).join(owned, ["user_id", "product_id"], "left_anti")
    again = wide.withColumn("recommendation_rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("trending_score"), "product_id"))).where(F.col("recommendation_rank") <= limit)
    fallback = again.select("user_id", "product_id", "product_name", "category", "price", F.col("trending_score").alias("recommendation_score"), F.lit("Popular across the store").alias("recommendation_reason"), F.lit("trending_fallback").alias("strategy"), "recommendation_rank")
    return served.unionByName(fallback)


def _ranked(layer: Layer, users: DataFrame, owned: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
    """The shelves of ``users`` (user_id, user_tier) from the three candidate sources."""
    c = layer.context
    cf = collaborative(layer, users, int(c["max_anchors_per_user"]))
    prefs = layer.user_category_preferences.select("user_id", "category_id", "category_affinity", "preference_rank").join(users, "user_id", "left_semi")
    pop = layer.product_popularity.where("is_active").select("product_id", "product_name", "category_id", F.col("category_name").alias("category"), "price", "smoothed_rating", "popularity_score", "popularity_category_rank", "recency_score")
    shelf = _shelves(pop, limit, c["weight_rating"] >= RATING_DECIDES)
    gone = owned.join(shelf, "product_id").groupBy("user_id", "category_id").agg(F.count("*").cast("int").alias("gone"))
    aisles = prefs.where(F.col("preference_rank") <= TOP_CATEGORIES).join(gone, ["user_id", "category_id"], "left")
    aisles = aisles.select("user_id", "category_id", F.explode(F.sequence(F.lit(0), F.coalesce("gone", F.lit(0)))).alias("reach"))
    nothing = [F.lit(None).cast(kind).alias(x) for x, kind in (("cf_score", "double"), ("supporting_anchors", "long"), ("top_anchor", "long"))]
    by_category = aisles.join(shelf, ["category_id", "reach"]).select("user_id", "product_id", F.lit(2).alias("priority"), *nothing)
    by_trend = users.where("user_tier <> 'warm'").select("user_id").crossJoin(hot).select("user_id", "product_id", F.lit(3).alias("priority"), *nothing)
    pool = cf.select("user_id", "product_id", F.lit(1).alias("priority"), "cf_score", "supporting_anchors", "top_anchor").unionByName(by_category).unionByName(by_trend)
    pool = pool.groupBy("user_id", "product_id").agg(F.min("priority").alias("priority"), *(F.max(x).alias(x) for x in ("cf_score", "supporting_anchors", "top_anchor")))
    facts = pop.join(layer.product_trend.select("product_id", "momentum"), "product_id", "left")
    rows = pool.join(owned, ["user_id", "product_id"], "left_anti").join(facts, "product_id").join(prefs, ["user_id", "category_id"], "left")
    rows = rows.withColumns({"cf_score": rnd(F.coalesce("cf_score", F.lit(0.0)), 9), "affinity": F.coalesce("category_affinity", F.lit(0.0)), "momentum": F.coalesce("momentum", F.lit(1.0))})
    user = W.partitionBy("user_id")
    signals = {"n_sim": "cf_score", "n_cat": "affinity", "n_pop": "popularity_score", "n_rat": "smoothed_rating", "n_rec": "recency_score"}
    rows = rows.withColumns({n: minmax(x, user) for n, x in signals.items()})
    weights = {"n_sim": "weight_similarity", "n_cat": "weight_category", "n_pop": "weight_popularity", "n_rat": "weight_rating", "n_rec": "weight_recency"}
    blend = F.lit(0.0)
    for n, w in weights.items():
        blend = blend + F.col(n) * c[w]
    rows = rows.withColumn("recommendation_score", rnd(blend, 6))
    rank = F.row_number().over(user.orderBy(F.desc("recommendation_score"), "product_id"))
    rows = rows.withColumn("recommendation_rank", rank).where(F.col("recommendation_rank") <= limit)
    names = layer.retail.products.select(F.col("product_id").alias("top_anchor"), F.col("name").alias("anchor_name"))
    rows = rows.join(names, "top_anchor", "left")
    strategy = F.element_at(F.array(*map(F.lit, ("collaborative_filtering", "category_affinity", "trending"))), F.col("priority"))
    return rows.select("user_id", "product_id", "product_name", "category", "price", "recommendation_score", _reason(c).alias("recommendation_reason"), strategy.alias("strategy"), "recommendation_rank")


def similar(layer: Layer, limit: int = 10, product_ids: DataFrame | None = None) -> DataFrame:
    """Neighbours of every product (or of those given), with how they relate."""
    info = layer.retail.products
    target = info.where("is_active").select("product_id", F.col("name").alias("product_name"), F.col("category_name").alias("category"), "brand", "price")
    source = info.select(F.col("product_id").alias("source_product_id"), F.col("brand").alias("source_brand"))
    if product_ids is not None:
        source = source.join(product_ids.select(F.col("product_id").alias("source_product_id")), "source_product_id", "left_semi")
    sim = layer.product_similarity.withColumnsRenamed({"product_a": "source_product_id", "product_b": "product_id"})
    rows = sim.join(target, "product_id").join(source, "source_product_id")
    label = (
        F.when(F.col("same_subcategory") & (F.col("brand") == F.col("source_brand")), F.concat(F.lit("Same range from "), "brand"))
        .when(F.col("same_subcategory"), "Direct alternative")
        .when(F.col("same_category"), "Frequently bought alongside")
        .when(F.col("jaccard_similarity") >= 0.10, "Shoppers pair these up")
        .otherwise("Discovered through shared audience")
    )
    rank = F.row_number().over(W.partitionBy("source_product_id").orderBy(F.desc("similarity_score"), "product_id"))
    rows = rows.withColumns({"k": rank, "relationship": label}).where(F.col("k") <= limit)
    return rows.select("source_product_id", "product_id", "product_name", "category", "brand", "price", "similarity_score", "common_users", F.lit("collaborative").alias("similarity_basis"), "relationship")
