"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ENCODE_BYTES, joined, prepare, text_of
from larkspur.llm.encoding import encoder

#: Tokens above which a document is marked.
LIMIT = 2048
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row a row.

    Lengths alone leave the Arrow function. A null text counts as empty (0
    bytes, 0 tokens); a null doc_id stays null; repeated rows stay; other
    columns are not read; an empty table gives an empty result. Texts of any
    length are cut where no token can span the cut, and what was not met before
    is asked of the library in batches of about equal bytes (:mod:`encoding`).
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, ENCODE_BYTES):
            with encoder(path, keep_ids=False) as made:
                counts = made.counts(batch.column(1))
            columns = [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _SCHEMA)
