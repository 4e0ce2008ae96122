"""Single requests over a layer, with what a caller must be told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import moment
from larkspur.operators import search, serving
from larkspur.operators.features import Layer
from larkspur.sources.files import read_report

#: Bounds of a request.
MOST, LEAST_QUERY = 100, 2


def _checked(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit {limit} is not from 1 to {MOST}")
    return limit


def health(layer: Layer) -> DataFrame:
    """One row: the clock, and whether the layer has anything to serve."""
    pairs = layer.product_similarity.agg(F.count("*").alias("similarity_pairs"))
    products = layer.retail.products.agg(F.count_if("is_active").alias("products"))
    row = pairs.crossJoin(F.broadcast(products))  # one row each
    return row.select(F.lit("ok").alias("status"), F.lit(layer.context.mode).alias("pipeline_mode"), moment(layer.context.as_of).alias("pipeline_as_of"), "similarity_pairs", "products")


def recommendations(layer: Layer, user_id: int, limit: int = 10) -> DataFrame:
    """The shelf of one user with the user's tier, ``unknown`` for a user who isn't known."""
    user = layer.retail.spark.createDataFrame([(user_id,)], "user_id long")
    tier = user.join(layer.user_profile.select("user_id", "user_tier"), "user_id", "left").select("user_id", F.coalesce("user_tier", F.lit("unknown")).alias("user_tier"))
    return serving.recommend(layer, user, _checked(limit)).join(F.broadcast(tier), "user_id")


def similar_products(layer: Layer, product_id: int, limit: int = 10) -> DataFrame:
    """Neighbours of one product, from its content if it has no others; KeyError if it is absent."""
    one = layer.retail.products.where(F.col("product_id") == product_id).select("product_id")
    if one.isEmpty():
        raise KeyError(product_id)
    return search.similar(layer, _checked(limit), one)


def search_products(layer: Layer, query: str, limit: int = 20) -> DataFrame:
    """Search results; ValueError for a query of under two characters."""
    if len(query) < LEAST_QUERY:
        raise ValueError("the query is too short")
    return search.search(layer, query, _checked(limit)).drop("text_rank")


def evaluation(path: str) -> dict:
    """The last evaluation report; FileNotFoundError if there is none."""
    found = read_report(path)
    if found is None:
        raise FileNotFoundError(path)
    return found
