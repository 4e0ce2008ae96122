"""A corpus pipeline: language, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's documents. All but the last return the columns
of the documents they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, mixing, neardup, packing, quality
from larkspur.llm.common import Steps, delete_path, new_path, prepare, quantile

#: Documents that score below this are junk to the quality stage: the lowest of
#: 0.05, 0.1, 0.2 to 0.9 with the least sum of the share of label 0 that passes and the
#: share of label 1 that is lost, on held-out halves of the labelled rows of sf0.1.
REJECT_BELOW = 0.3


#: The language stage rejects scores below this share of the score that 1 % of
#: all documents with a language stay under.
FLOOR_SHARE = 0.5


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name clashes with a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def language_floor(docs: DataFrame, profiles: langid.Profiles) -> float:
    """The least score of a document in a language of the profiles; 0 if none was learned.

    All rows with lang, text and doc_id are scored and counted; their scores are
    written, so that each is computed once here, and deleted.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    scored = known.select(langid.prediction(profiles)().alias("p")).where(F.col("p.lang_pred") != langid.UNKNOWN)
    with Steps(docs.sparkSession) as steps:
        least = quantile(steps.write(scored.select("p.score"), "scores"), "score", 0.01)
    return 0.0 if least is None else FLOOR_SHARE * least


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (``und``) and those unlike all languages:
    of a score below the floor that the training documents give. All documents
    with a language are training documents.

    A null or empty text has no letter and goes; if no language can be learned
    (no row with lang, text and doc_id), all rows go. Repeated rows, rows with
    null ids and long texts are judged each, as whole; an empty table stays empty.
    """
    prepare(spark)
    profiles = langid.train(docs, sample=None)
    floor = language_floor(docs, profiles)
    found = docs.select(whole(docs), langid.prediction(profiles)().alias("p"))
    return found.where((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.score") >= floor)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below ``REJECT_BELOW``.

    A null text scores as an empty one; null ids and repeated rows are scored
    each; without labels nothing is learned, every score is 0.5, and all rows
    stay; an empty table stays empty.
    """
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(whole(docs), quality.score_column(model)().alias("score")).where(F.col("score") >= REJECT_BELOW).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates.

    Nulls, texts without words and repeated rows: see ``neardup.drop_duplicates``.
    """
    prepare(spark)
    return neardup.drop_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by source to the target weights, in curriculum order.

    Documents without words are not taken, so null and empty texts go; a null
    source is a source of its own. See ``mixing.apply``.
    """
    prepare(spark)
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; a row per piece.

    Repeated rows are packed each; a null text is an empty one; an empty table
    gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_id), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    held, docs = "", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            delete_path(spark, held)
        held, docs = path, spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, similarity components and a tokenizer are beyond SQL; run() is
#: tested on a small fixture against a plain Python version that shares the models
#: and the tokenizer.
ORACLE_SQL = None
