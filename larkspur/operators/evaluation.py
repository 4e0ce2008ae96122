"""Leak-free temporal evaluation: cutoff, held-out purchases, baselines, metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.exprs import div, is_kind, micros, moment, rnd
from larkspur.operators import serving
from larkspur.operators.features import Layer, stored
from larkspur.sources.retail import Retail

#: The split, the sample of the coverage report, anchors of the baseline.
SPLIT, COVERAGE_USERS, CF_ANCHORS = 0.8, 300, 50


def cutoff(retail: Retail, share: float = SPLIT) -> DataFrame:
    """One row: the discrete percentile of the event times, exact to the microsecond.

    Events are counted by hour, running counts tell the hour that holds the
    percentile, and only its times are ranked: no task holds all times.
    """
    rows = retail.interactions.select(micros(F.col("interaction_timestamp")).alias("us")).where("us is not null").withColumn("hour", F.expr("us div 3600000000"))
    hours = rows.groupBy("hour").agg(F.count("*").alias("n"))
    until = W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    hours = hours.select("hour", F.sum("n").over(until).alias("until"), "n", F.sum("n").over(W.partitionBy()).alias("total"))
    place = F.greatest(F.ceil(F.col("total") * F.lit(share)), F.lit(1))
    found = hours.where(F.col("until") >= place).orderBy("hour").limit(1).select("hour", (place - F.col("until") + F.col("n")).alias("place"))
    inside = rows.join(F.broadcast(found), "hour").groupBy("us", "place").agg(F.count("*").alias("n"))  # found: one row
    inside = inside.withColumn("until", F.sum("n").over(W.orderBy("us").rowsBetween(W.unboundedPreceding, 0))).where(F.col("until") >= F.col("place"))
    return inside.agg(F.min("us").alias("us")).select(F.timestamp_micros("us").cast("timestamp_ntz").alias("cutoff"))


def cutoff_time(retail: Retail) -> datetime:
    return cutoff(retail).first()[0]


def ground_truth(layer: Layer) -> DataFrame:
    """First purchases at or after the clock of products that the user had not bought before it."""
    bought = layer.retail.interactions.where(is_kind("purchase"))
    at = moment(layer.context.as_of)
    before = bought.where(F.col("interaction_timestamp") < at).select("user_id", "product_id").distinct()
    later = bought.where(F.col("interaction_timestamp") >= at).join(before, ["user_id", "product_id"], "left_anti")
    return later.groupBy("user_id", "product_id").agg(F.min("interaction_timestamp").alias("first_purchase"))


def candidate_users(layer: Layer) -> DataFrame:
    counts = ground_truth(layer).groupBy("user_id").agg(F.count("*").alias("held_out_purchases"))
    return layer.user_profile.select("user_id", "user_tier", "distinct_products").join(counts, "user_id")


def sample_users(layer: Layer, n: int) -> DataFrame:
    """A deterministic sample by md5 of the id."""
    return candidate_users(layer).orderBy(F.md5(F.col("user_id").cast("string")), "user_id").limit(n)


def split_stats(layer: Layer) -> DataFrame:
    before = F.col("interaction_timestamp") < moment(layer.context.as_of)
    return layer.retail.interactions.agg(F.count_if(before).alias("train_events"), F.count_if(~before).alias("test_events"), F.count_if(~before & is_kind("purchase")).alias("test_purchases"))


def popularity_baseline(layer: Layer, users: DataFrame, limit: int = 10) -> DataFrame:
    """The most popular active products that a user has not bought.

    A user needs the first ``limit`` products of the global order and one more for
    each product owned, so the join meets only those places.
    """
    owned = layer.user_product_features.where("has_purchased").select("user_id", "product_id").join(users.select("user_id"), "user_id", "left_semi")
    order = W.orderBy(F.desc("decayed_engagement"), "product_id")
    active = layer.product_popularity.where("is_active").select("product_id", F.col("popularity_score").alias("score"), "decayed_engagement")
    ranked = active.withColumn("place", F.row_number().over(order)).select("product_id", "score", "place")
    own = owned.groupBy("user_id").agg(F.count("*").cast("int").alias("own"))
    needed = users.select("user_id").join(own, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1), F.lit(limit) + F.coalesce("own", F.lit(0)))).alias("place"))
    rows = needed.join(ranked, "place").join(owned, ["user_id", "product_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("user_id", "product_id", "score", "rank")


def cf_baseline(layer: Layer, users: DataFrame, limit: int = 10) -> DataFrame:
    """Collaborative filtering alone, over at most ``CF_ANCHORS`` anchors."""
    owned = layer.user_product_features.where("has_purchased").select("user_id", "product_id")
    active = layer.retail.products.where("is_active").select("product_id")
    rows = serving.collaborative(layer, users, CF_ANCHORS).join(active, "product_id", "left_semi").join(owned, ["user_id", "product_id"], "left_anti")
    rows = rows.withColumn("score", rnd("cf_score", 6))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "product_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("user_id", "product_id", "score", "rank")


def _hybrid(layer: Layer, users: DataFrame, limit: int) -> DataFrame:
    rows = serving.recommend(layer, users, limit)
    return rows.select("user_id", "product_id", F.col("recommendation_score").alias("score"), F.col("recommendation_rank").alias("rank"))


STRATEGIES = {"popularity": popularity_baseline, "collaborative": cf_baseline, "hybrid": _hybrid}


def strategy_recommendations(layer: Layer, strategy: str, users: DataFrame, limit: int = 10) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return STRATEGIES[strategy](layer, users, limit)


def coverage_report(layer: Layer, strategy: str, sample: int = COVERAGE_USERS, limit: int = 10) -> DataFrame:
    users = candidate_users(layer).orderBy("user_id").limit(sample)
    rows = strategy_recommendations(layer, strategy, users, limit).join(layer.product_popularity.select("product_id", "demand_tier"), "product_id")
    active = layer.retail.products.agg(F.count_if("is_active").alias("active"))
    out = rows.agg(F.count_distinct("user_id").alias("users_sampled"), F.count_distinct("product_id").alias("distinct_products"), F.count_if(F.col("demand_tier") == "head").alias("head"), F.count("*").alias("n"))
    out = out.crossJoin(F.broadcast(active))
    return out.select(F.lit(strategy).alias("strategy"), "users_sampled", "distinct_products", rnd(div("distinct_products", "active"), 4).alias("catalogue_coverage"), rnd(div("head", "n"), 4).alias("head_share"))


def metrics(recommended: DataFrame, truth: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Per user: precision, recall, hit rate and NDCG at ``k``, and whether anything was served.

    Precision divides by ``k`` even if fewer were served; recall is 0 without truth.
    """
    gain = F.try_divide(F.lit(1.0), F.log2(F.col("rank") + F.lit(1.0)))
    flagged = recommended.where(F.col("rank") <= k).join(truth.select("user_id", "product_id", F.lit(1).alias("hit")), ["user_id", "product_id"], "left")
    got = flagged.groupBy("user_id").agg(F.count("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, gain).otherwise(0.0)).alias("dcg"))
    size = truth.groupBy("user_id").agg(F.count("*").alias("truth_size"))
    rows = users.select("user_id", "user_tier").join(size, "user_id", "left").join(got, "user_id", "left")
    n, hits = F.coalesce("truth_size", F.lit(0)), F.coalesce("hits", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0)))
    return rows.select(
        "user_id",
        "user_tier",
        (hits / F.lit(float(k))).alias("precision"),
        F.coalesce(div(hits, n), F.lit(0.0)).alias("recall"),
        (hits > 0).cast("double").alias("hit_rate"),
        F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        F.col("hits").isNotNull().cast("double").alias("served"),
    )


def metrics_by_tier(layer: Layer, strategy: str, k: int = 10, sample: int | None = None) -> DataFrame:
    """Mean metrics per tier and overall, in one pass."""
    users = candidate_users(layer) if sample is None else sample_users(layer, sample)
    rows = metrics(strategy_recommendations(layer, strategy, users, k), ground_truth(layer), users, k)
    names = ("precision", "recall", "hit_rate", "ndcg", "served")
    out = rows.rollup("user_tier").agg(F.count("*").alias("users"), *(rnd(F.avg(x), 4).alias(x) for x in names))
    return out.select(F.lit(strategy).alias("strategy"), F.lit(k).alias("k"), F.coalesce("user_tier", F.lit("overall")).alias("tier"), "users", *names)


def run_evaluation(retail: Retail, ks: tuple[int, ...] = (5, 10), sample: int | None = None) -> DataFrame:
    """All strategies at the cutoff. The layer is a function of the clock, so nothing has to be restored."""
    layer = stored(Layer(retail, retail.behaviour_clock().with_as_of(cutoff_time(retail))))
    parts = [metrics_by_tier(layer, s, k, sample) for s in STRATEGIES for k in ks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
