"""Order statistics that no single task computes from all rows.

Values are counted by bucket, running counts over the few buckets tell which of
them matter, and only their values are ranked. Rows are exact; the bucket's width
only decides how much is ranked at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of a bucket of amounts.
WIDTH = 1000


def _bucket(value: str) -> Column:
    return F.floor(F.col(value).cast("double") / WIDTH)


def rank_threshold(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row: ``least``, the least value whose percent rank is ``share`` or more; null if there is none."""
    cut = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), _bucket(value).alias("bucket"))
    buckets = cut.groupBy("bucket").agg(F.count("*").alias("n"))
    until = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    buckets = buckets.select("bucket", (until - F.col("n")).alias("before"), until.alias("until"), F.sum("n").over(W.partitionBy()).alias("all"))
    some = buckets.where(F.try_divide(F.col("until"), F.col("all") - 1) >= share).orderBy("bucket").limit(2)  # the second for ties at the end of the first
    inside = cut.join(F.broadcast(some), "bucket").groupBy("bucket", "v", "before", "all").agg(F.count("*").alias("n"))
    smaller = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = inside.withColumn("p", F.try_divide(smaller, F.col("all") - 1))
    return ranked.where(F.col("p") >= share).agg(F.min("v").alias("least"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group`` and median, the mean of the middle value or two, as a double."""
    cut = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), _bucket(value).alias("bucket"))
    buckets = cut.groupBy("g", "bucket").agg(F.count("*").alias("n"))
    until = F.sum("n").over(W.partitionBy("g").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    buckets = buckets.select("g", "bucket", (until - F.col("n")).alias("before"), until.alias("until"), F.sum("n").over(W.partitionBy("g")).alias("all"))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1  # places from 1
    some = buckets.where((F.col("before") < high) & (F.col("until") >= low)).select("g", "bucket", "before", low.alias("low"), high.alias("high"))
    inside = cut.join(some, ["g", "bucket"]).groupBy("g", "bucket", "v", "before", "low", "high").agg(F.count("*").alias("n"))
    last = F.col("before") + F.sum("n").over(W.partitionBy("g", "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
    times = sum(((F.col("first") <= F.col(at)) & (F.col(at) <= F.col("last"))).cast("int") for at in ("low", "high"))
    return placed.groupBy("g").agg((F.sum(F.col("v") * times) / 2.0).alias("median")).withColumnRenamed("g", group)
