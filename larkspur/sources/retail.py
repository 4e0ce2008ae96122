"""The retail model as views of the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.context import Context


@dataclass(frozen=True)
class Retail:
    """Lazy relations over one folder of Parquet tables."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def interactions(self) -> DataFrame:
        kind = F.col("event_type")
        named = F.when(kind == "signup", "wishlist").when(kind == "click", "cart").otherwise(kind)
        rows = self.table("events").where(kind.isin("view", "signup", "click", "purchase"))
        return rows.select(
            F.col("event_id").alias("interaction_id"),
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("product_id"),
            named.alias("interaction_type"),
            F.col("ts").alias("interaction_timestamp"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """A line per order and product; ``revenue`` is exact."""
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
        out = lines.agg(F.sum("l_quantity").cast("long").alias("quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("revenue"))
        return out.withColumn("unit_price", F.col("revenue").cast("double") / F.col("quantity"))

    @cached_property
    def order_lines(self) -> DataFrame:
        """Order and product of each line, as they are."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))

    @cached_property
    def ratings(self) -> DataFrame:
        """The latest rating of a user for a product."""
        lines = self.table("lineitem").join(self.orders, F.col("l_orderkey") == F.col("order_id"))
        order = F.struct("order_date", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
        stars = (1 + F.round(F.col("l_tax") * 100).cast("int") % 5).alias("rating")
        last = lines.groupBy("user_id", F.col("l_partkey").alias("product_id")).agg(F.max_by(F.struct(stars, F.col("order_date").alias("created_at")), order).alias("r"))
        return last.select("user_id", "product_id", "r.rating", "r.created_at")

    @cached_property
    def products(self) -> DataFrame:
        part = self.table("part")
        names = F.broadcast(part.select("p_type").distinct().withColumn("category_id", F.dense_rank().over(W.orderBy("p_type")).cast("int")))
        return part.join(names, "p_type").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            "category_id",
            F.col("p_type").alias("category_name"),
            F.concat(F.lit("size_"), F.floor((F.col("p_size") - 1) / 10).cast("int").cast("string")).alias("subcategory"),
            F.col("p_brand").alias("brand"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
            F.col("p_retailprice").cast("decimal(10,2)").cast("double").alias("price"),
            (F.col("p_size") > 2).alias("is_active"),
        )

    @cached_property
    def users(self) -> DataFrame:
        first = self.orders.groupBy("user_id").agg(F.min("order_date").cast("date").alias("signup_date"))
        nation = F.broadcast(self.table("nation").select("n_nationkey", F.col("n_name").alias("city")))
        rows = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("user_id", F.col("c_custkey"))
        rows = rows.join(first, "user_id", "left")
        signup = F.coalesce("signup_date", F.lit("1995-01-01").cast("date"))
        return rows.select("user_id", "city", F.col("c_mktsegment").alias("persona"), signup.alias("signup_date"))

    def behaviour_clock(self) -> Context:
        """A second after the last interaction."""
        return Context(_after(self.interactions.agg(F.max("interaction_timestamp")).first()[0]))

    def ledger_clock(self) -> Context:
        """A second after the last order."""
        return Context(_after(self.orders.agg(F.max("order_date")).first()[0]))


def _after(last: datetime | None) -> datetime:
    return (last or datetime(1970, 1, 1)) + timedelta(seconds=1)
