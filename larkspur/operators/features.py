"""The offline layer: features, preferences, popularity, trend, similarity, profile.

All of them read only what happened before the context's clock. Shuffles are on
user or product; the windows over all products sort the catalogue alone.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.context import Context
from larkspur.functions.exprs import age_days, decay, div, is_kind, moment, rnd, weight
from larkspur.sources.files import Snapshots, fingerprint, shared_dir
from larkspur.sources.retail import Retail

TREND_WEEKS = 16


def _kinds() -> list[Column]:
    return [F.count_if(is_kind(k)).alias(f"{k}_count") for k in ("view", "wishlist", "cart", "purchase")]


@dataclass(frozen=True)
class Layer:
    """The relations of one clock. Each is a plan, made at most once; :func:`refreshed`
    gives a layer whose relations are files instead."""

    retail: Retail
    context: Context

    @cached_property
    def log(self) -> DataFrame:
        return self.retail.interactions.where(F.col("interaction_timestamp") < moment(self.context.as_of))

    @cached_property
    def user_product_features(self) -> DataFrame:
        c, ts = self.context, F.col("interaction_timestamp")
        decayed = F.sum(weight() * decay(ts, c.as_of, c["affinity_half_life"]))
        return self.log.groupBy("user_id", "product_id").agg(
            *_kinds(),
            F.count("*").alias("interaction_count"),
            F.min(ts).alias("first_interaction"),
            F.max(ts).alias("last_interaction"),
            F.floor(age_days(F.max(ts), c.as_of)).cast("int").alias("days_since_interaction"),
            F.sum(weight()).cast("long").alias("interaction_score"),
            rnd(decayed, 4).alias("decayed_score"),
            F.bool_or(is_kind("purchase")).alias("has_purchased"),
        )

    @cached_property
    def user_category_preferences(self) -> DataFrame:
        items = self.retail.products.select("product_id", "category_id", "category_name")
        rows = self.user_product_features.join(items, "product_id").groupBy("user_id", "category_id", "category_name")
        rows = rows.agg(
            F.sum("interaction_score").cast("long").alias("interaction_score"),
            rnd(F.sum(F.col("decayed_score").cast("decimal(18,4)")), 4).alias("decayed_score"),
            F.sum("purchase_count").cast("long").alias("purchase_count"),
            F.count("product_id").alias("distinct_products"),
            F.max("last_interaction").alias("last_interaction"),
        )
        user = W.partitionBy("user_id")
        strongest = user.orderBy(F.desc("decayed_score"))
        total = F.sum(F.col("decayed_score").cast("decimal(18,4)")).over(user)
        return rows.withColumns(
            {
                "category_affinity": rnd(div("decayed_score", total), 4),
                "preference_rank": F.row_number().over(user.orderBy(F.desc("decayed_score"), "category_id")),
                "preference_rank_with_ties": F.rank().over(strongest),
                "preference_tier": F.dense_rank().over(strongest),
                "affinity_percentile": rnd(F.percent_rank().over(user.orderBy("decayed_score")), 4),
            }
        )

    @cached_property
    def rating_summary(self) -> DataFrame:
        rows = self.retail.ratings.where(F.col("created_at") < moment(self.context.as_of)).groupBy("product_id")
        return rows.agg(rnd(F.avg("rating"), 3).alias("avg_rating"), F.count("*").alias("rating_count"))

    @cached_property
    def rating_prior(self) -> DataFrame:
        """One row: the catalogue's mean rating and the votes that the mean is worth."""
        votes = F.greatest(F.coalesce(F.median("rating_count"), F.lit(10.0)), F.lit(5.0))
        mean = div(F.sum(F.col("avg_rating").cast("decimal(18,3)")), F.count("avg_rating"))
        return self.rating_summary.agg(F.coalesce(mean, F.lit(3.5)).alias("global_mean"), votes.alias("prior_votes"))

    @cached_property
    def product_popularity(self) -> DataFrame:
        c, ts = self.context, F.col("interaction_timestamp")
        used = self.log.groupBy("product_id").agg(
            *_kinds(),
            F.count_distinct("user_id").alias("unique_users"),
            F.sum(weight()).cast("long").alias("raw_engagement"),
            F.sum(weight() * decay(ts, c.as_of, c["popularity_half_life"])).alias("decayed"),
            F.max(ts).alias("last_interaction"),
        )
        rows = self.retail.products.drop("description").withColumnRenamed("name", "product_name")
        rows = rows.join(used, "product_id", "left").join(self.rating_summary, "product_id", "left").crossJoin(F.broadcast(self.rating_prior))
        counts = ["view_count", "wishlist_count", "cart_count", "purchase_count", "unique_users", "raw_engagement", "rating_count"]
        n = F.coalesce("rating_count", F.lit(0))
        smoothed = (n * F.coalesce("avg_rating", "global_mean") + F.col("prior_votes") * F.col("global_mean")) / (n + F.col("prior_votes"))
        rows = rows.withColumns(
            {
                "smoothed_rating": rnd(smoothed, 4),
                "view_to_purchase_rate": rnd(div(F.coalesce("purchase_count", F.lit(0)), "view_count"), 4),
                "decayed_engagement": rnd(F.coalesce("decayed", F.lit(0.0)), 4),
                "days_since_last_interaction": F.floor(age_days(F.col("last_interaction"), c.as_of)).cast("int"),
                "recency_score": rnd(decay(F.col("last_interaction"), c.as_of, c["popularity_half_life"]), 4),
                **{x: F.coalesce(x, F.lit(0)).cast("long") for x in counts},
            }
        ).drop("decayed", "global_mean", "prior_votes")
        most = F.desc("decayed_engagement")
        quarter = F.ntile(4).over(W.orderBy(most, "product_id"))
        return rows.withColumns(
            {
                "popularity_score": rnd(F.percent_rank().over(W.orderBy("decayed_engagement")), 4),
                "popularity_global_rank": F.row_number().over(W.orderBy(most, "product_id")),
                "popularity_category_rank": F.rank().over(W.partitionBy("category_id").orderBy(most)),
                "demand_tier": F.element_at(F.array(*map(F.lit, ("head", "upper_torso", "lower_torso", "long_tail"))), quarter),
            }
        )

    @cached_property
    def product_trend(self) -> DataFrame:
        since = moment(self.context.as_of - timedelta(weeks=TREND_WEEKS))
        week = F.date_trunc("week", F.col("interaction_timestamp")).cast("timestamp_ntz")
        weekly = self.log.where(F.col("interaction_timestamp") >= since).groupBy("product_id", week.alias("latest_week"))
        weekly = weekly.agg(F.sum(weight()).cast("long").alias("latest_week_engagement"))
        w = W.partitionBy("product_id").orderBy("latest_week")
        rows = weekly.withColumns(
            {
                "previous_week_engagement": F.lag("latest_week_engagement").over(w),
                "average": F.avg("latest_week_engagement").over(w.rowsBetween(-3, 0)),
                "cumulative_engagement": F.sum("latest_week_engagement").over(w.rowsBetween(W.unboundedPreceding, 0)),
                "back": F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("latest_week"))),
            }
        ).where("back = 1")
        now, before = F.col("latest_week_engagement"), F.col("previous_week_engagement")
        direction = F.when(before.isNull(), "new").when(now > before * 1.25, "rising").when(now < before * 0.75, "falling").otherwise("steady")
        return rows.select(
            "product_id",
            "latest_week",
            "latest_week_engagement",
            "previous_week_engagement",
            rnd("average", 4).alias("trailing_4week_average"),
            "cumulative_engagement",
            F.least(rnd(div(now, "average"), 4), F.lit(5.0)).alias("momentum"),
            direction.alias("trend_direction"),
        )

    @cached_property
    def capped(self) -> DataFrame:
        """A user's strongest products with damped weights; the cap bounds the pair join."""
        rows = self.user_product_features.where("decayed_score > 0").select("user_id", "product_id", F.log1p("decayed_score").alias("weight"))
        rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("weight"), "product_id"))
        return rows.withColumn("k", rank).where(F.col("k") <= int(self.context["max_anchors_per_user"])).drop("k")

    @cached_property
    def similarity_pairs(self) -> DataFrame:
        """product_a < product_b with cosine and Jaccard, above the support floor."""
        norms = self.capped.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.count("*").alias("audience"))
        a, b = self.capped.alias("a"), self.capped.alias("b")
        both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.product_id") < F.col("b.product_id")))
        both = both.groupBy(F.col("a.product_id").alias("product_a"), F.col("b.product_id").alias("product_b"))
        both = both.agg(F.count("*").alias("common_users"), F.sum(F.col("a.weight") * F.col("b.weight")).alias("dot"))
        both = both.where(F.col("common_users") >= int(self.context["min_common_users"]))
        na = norms.select(F.col("product_id").alias("product_a"), F.col("norm").alias("norm_a"), F.col("audience").alias("audience_a"))
        nb = norms.select(F.col("product_id").alias("product_b"), F.col("norm").alias("norm_b"), F.col("audience").alias("audience_b"))
        cosine = div("dot", F.col("norm_a") * F.col("norm_b"))
        jaccard = div("common_users", F.col("audience_a") + F.col("audience_b") - F.col("common_users"))
        return both.join(na, "product_a").join(nb, "product_b").select("product_a", "product_b", "common_users", rnd(cosine, 6).alias("cosine_similarity"), rnd(jaccard, 6).alias("jaccard_similarity"))

    @cached_property
    def product_similarity(self) -> DataFrame:
        half = self.similarity_pairs
        other = half.select(F.col("product_b").alias("product_a"), F.col("product_a").alias("product_b"), "common_users", "cosine_similarity", "jaccard_similarity")
        rank = F.row_number().over(W.partitionBy("product_a").orderBy(F.desc("cosine_similarity"), "product_b"))
        kept = half.unionByName(other).withColumn("neighbour_rank", rank).where(F.col("neighbour_rank") <= int(self.context["max_neighbours_per_item"]))
        info = self.retail.products
        a = info.select(F.col("product_id").alias("product_a"), F.col("subcategory").alias("sub_a"), F.col("category_id").alias("cat_a"))
        b = info.select(F.col("product_id").alias("product_b"), F.col("subcategory").alias("sub_b"), F.col("category_id").alias("cat_b"))
        rows = kept.join(a, "product_a").join(b, "product_b")
        same = [(F.col("sub_a") == F.col("sub_b")).alias("same_subcategory"), (F.col("cat_a") == F.col("cat_b")).alias("same_category")]
        return rows.select("product_a", "product_b", "common_users", "cosine_similarity", "jaccard_similarity", F.col("cosine_similarity").alias("similarity_score"), "neighbour_rank", *same)

    @cached_property
    def user_profile(self) -> DataFrame:
        per = self.user_product_features.groupBy("user_id").agg(
            F.count("*").alias("distinct_products"),
            F.sum("interaction_count").cast("long").alias("total_interactions"),
            F.count_if("has_purchased").alias("purchased_products"),
            F.max("last_interaction").alias("last_activity"),
        )
        aisles = self.user_category_preferences.groupBy("user_id").agg(F.count("*").alias("distinct_categories"))
        rows = self.retail.users.select("user_id", "signup_date").join(per, "user_id", "left").join(aisles, "user_id", "left")
        n = F.coalesce("distinct_products", F.lit(0))
        tier = F.when(n < int(self.context["cold_start_threshold"]), "cold").when(n < int(self.context["light_user_threshold"]), "light").otherwise("warm")
        counts = {x: F.coalesce(x, F.lit(0)).cast("long") for x in ("distinct_products", "total_interactions", "purchased_products", "distinct_categories")}
        return rows.withColumn("user_tier", tier).withColumns(counts)


#: The relations that a refresh writes, each built from those before it, and the
#: column that its point reads go by.
RELATIONS = {
    "user_product_features": "user_id",
    "user_category_preferences": "user_id",
    "product_popularity": "product_id",
    "product_trend": "product_id",
    "product_similarity": "product_a",
}


def refreshed(layer: Layer, snapshots: Snapshots) -> tuple[Layer, list[tuple[str, int, float]]]:
    """Write the relations of ``layer`` and give the layer that reads them, and
    (layer, rows_loaded, elapsed_seconds) of each. Readers of older versions go on."""
    out, report = Layer(layer.retail, layer.context), []
    for name, by in RELATIONS.items():
        start = time.perf_counter()
        out.__dict__[name] = snapshots.refresh(name, lambda n=name: getattr(out, n), by)
        report.append((name, out.__dict__[name].count(), round(time.perf_counter() - start, 3)))
    return out, report


def stored(layer: Layer, anew: bool = False) -> Layer:
    """The layer read from the shared folder, written first if these tables, clock and
    settings have none yet, or if it is asked for ``anew``."""
    spark, retail = layer.retail.spark, layer.retail
    tables = [f"{retail.path}/{name}.parquet" for name in ("events", "orders", "lineitem", "customer", "nation", "part")]
    told = f"{retail.path} {fingerprint(spark, tables)} {layer.context}"
    snapshots = Snapshots(spark, f"{shared_dir(spark)}/layer-{hashlib.sha256(told.encode()).hexdigest()[:24]}")
    if anew or any(snapshots.version(name) is None for name in RELATIONS):
        return refreshed(layer, snapshots)[0]
    out = Layer(retail, layer.context)
    out.__dict__.update({name: snapshots.read(name) for name in RELATIONS})
    return out
