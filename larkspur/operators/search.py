"""Text search over the catalogue: field weights, boolean queries, content neighbours.

Tokens are stems of runs of a-z and 0-9 in lower case, without stop words. A
query has words (all must occur), quoted phrases, ``or`` between alternatives
and a leading minus for exclusion. Relevance is the weighted number of
occurrences of the query's words, and of fields in which two that follow each
other in the query stand side by side, log-damped.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.exprs import minmax, rnd
from larkspur.functions.words import stems, stems_of
from larkspur.operators import serving
from larkspur.operators.features import Layer

#: Weights of the fields, and of relevance and popularity.
FIELDS = {"name": 1.0, "brand": 0.4, "subcategory": 0.4, "description": 0.2}
TEXT_SHARE, POPULARITY_SHARE = 0.70, 0.30
#: Fixed value: how a content neighbour relates.
CONTENT = "Similar catalogue entry, no purchase history yet"
SAMPLE_QUERY = 'small bolts or "the red widgets" or gears -hot'


def _occurrences(words: list[str]) -> Column:
    total = F.lit(0.0)
    for field, weight in FIELDS.items():
        for word in words:
            others = F.size(F.array_remove(F.col(f"t_{field}"), word))
            total = total + (F.size(F.col(f"t_{field}")) - others) * F.lit(weight)
    return total


def _holds(field: str, phrase: list[str]) -> Column:
    return F.contains(F.concat(F.lit(" "), F.array_join(f"t_{field}", " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def _has(phrase: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (_holds(f, phrase) for f in FIELDS))


def _side_by_side(pairs: list[list[str]]) -> Column:
    return sum((F.when(_holds(field, pair), weight).otherwise(0.0) for field, weight in FIELDS.items() for pair in pairs), F.lit(0.0))


def parse(query: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """Alternatives of phrases that must all occur, and phrases that must not, as stems."""
    groups: list[list[list[str]]] = [[]]
    banned: list[list[str]] = []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not minus and not quoted and word.lower() == "or":
            groups.append([])
        elif phrase := stems_of(quoted or word):
            (banned if minus else groups[-1]).append(phrase)
    return [g for g in groups if g], banned


def _indexed(layer: Layer) -> DataFrame:
    """The products with the tokens of their fields, which the generator makes once a
    row; as plain columns they would be made anew in every condition."""
    texts = F.array(*(F.coalesce(f, F.lit("")) for f in FIELDS))
    rows = layer.retail.products.select("*", F.explode(F.array(F.transform(texts, stems))).alias("fields"))
    return rows.withColumns({f"t_{f}": F.col("fields")[i] for i, f in enumerate(FIELDS)}).drop("fields")


def _matching(layer: Layer, query: str) -> DataFrame:
    """The active products that match, with text_rank."""
    groups, banned = parse(query)
    if not groups:
        match: Column = F.lit(False)
    else:
        match = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, map(_has, g)) for g in groups))
    for phrase in banned:
        match = match & ~_has(phrase)
    words = sorted({w for g in groups for p in g for w in p})
    pairs = sorted({pair for g in groups for pair in pairwise(w for p in g for w in p)})
    hits = _occurrences(words) + _side_by_side([list(p) for p in pairs])
    return _indexed(layer).where(F.col("is_active") & match).withColumn("text_rank", rnd(F.log1p(hits), 6))


def search(layer: Layer, query: str, limit: int = 20) -> DataFrame:
    """Active products that match, by 0.70 relevance + 0.30 popularity, each
    min-max scaled over the matches (1 where all are equal)."""
    rows = _matching(layer, query).join(layer.product_popularity.select("product_id", "popularity_score"), "product_id")
    every = W.partitionBy()
    blend = minmax("text_rank", every, 1.0) * TEXT_SHARE + minmax("popularity_score", every, 1.0) * POPULARITY_SHARE
    rows = rows.select("product_id", F.col("name").alias("product_name"), F.col("category_name").alias("category"), "brand", "price", "text_rank", rnd(blend, 6).alias("blended_score"))
    return rows.orderBy(F.desc("blended_score"), "product_id").limit(limit)


def similar_by_content(layer: Layer, limit: int = 10, product_ids: DataFrame | None = None) -> DataFrame:
    """For products without collaborative neighbours: active products that hold
    every word of the source's name, brand and subcategory.

    The score is the weighted number of those words in the target, log-damped. A
    source's rarest word decides which products are looked at, so common words
    produce no pairs; equal word sets are matched once.
    """
    rows = _indexed(layer).select("product_id", "name", "category_name", "brand", "price", "is_active", F.array_sort(F.array_distinct(F.concat("t_name", "t_brand", "t_subcategory"))).alias("need"), F.array_distinct(F.concat(*(f"t_{f}" for f in FIELDS))).alias("have"), *(f"t_{f}" for f in FIELDS))
    served = layer.product_similarity.join(layer.retail.products.where("is_active").select(F.col("product_id").alias("product_b")), "product_b", "left_semi").select(F.col("product_a").alias("product_id")).distinct()
    source = rows.join(served, "product_id", "left_anti")
    if product_ids is not None:
        source = source.join(product_ids.select("product_id"), "product_id", "left_semi")
    held = rows.where("is_active").select(F.col("product_id").alias("id"), F.explode("have").alias("word"))
    spread = held.groupBy("word").agg(F.count("*").alias("n"))
    wanted = source.select("need").distinct()
    rare = wanted.select("need", F.explode("need").alias("word")).join(spread, "word", "left").groupBy("need").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    target = rows.where("is_active").select(F.col("product_id").alias("id"), F.col("name").alias("product_name"), F.col("category_name").alias("category"), F.col("brand").alias("brand2"), F.col("price").alias("price2"), "have", *(f"t_{f}" for f in FIELDS))
    found = rare.join(held, "word").join(target, "id").where(F.size(F.array_except("need", "have")) == 0)
    hits = sum((F.size(F.filter(f"t_{f}", lambda t: F.array_contains("need", t))) * F.lit(w) for f, w in FIELDS.items()), F.lit(0.0))
    found = found.withColumn("score", rnd(F.log1p(hits), 6))
    found = found.withColumn("place", F.row_number().over(W.partitionBy("need").orderBy(F.desc("score"), "id"))).where(F.col("place") <= limit + 1)
    both = source.select(F.col("product_id").alias("source_product_id"), "need").join(found, "need").where(F.col("id") != F.col("source_product_id"))
    rank = F.row_number().over(W.partitionBy("source_product_id").orderBy("place"))
    both = both.withColumn("k", rank).where(F.col("k") <= limit)
    return both.select("source_product_id", F.col("id").alias("product_id"), "product_name", "category", F.col("brand2").alias("brand"), F.col("price2").alias("price"), F.col("score").alias("similarity_score"), F.lit(0).cast("long").alias("common_users"), F.lit("content").alias("similarity_basis"), F.lit(CONTENT).alias("relationship"))


def similar(layer: Layer, limit: int = 10, product_ids: DataFrame | None = None) -> DataFrame:
    """Collaborative neighbours, and content neighbours for products that have none."""
    return serving.similar(layer, limit, product_ids).unionByName(similar_by_content(layer, limit, product_ids))


def matches(layer: Layer, query: str, limit: int = 20) -> DataFrame:
    """Active products that match, by relevance alone."""
    rows = _matching(layer, query).select("product_id", "name", F.col("text_rank").alias("rank"))
    return rows.orderBy(F.desc("rank"), "product_id").limit(limit)
