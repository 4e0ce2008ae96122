"""Language identification by rank-order profiles of character n-grams (Cavnar & Trenkle 1994)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import Steps, prepare, text_of

#: N-grams of a profile, and documents a language's profile is fitted on at
#: most (in expectation: those whose hashed id falls below the share).
PROFILE, SAMPLE = 400, 3000
#: N-grams that a task takes before it adds up their counts.
HELD = 1 << 19
#: Values of ``lang`` whose shares are broadcast; more are joined by a shuffle.
LANGS = 10_000
#: No letter at all.
UNKNOWN = "und"
_SPREAD = 16
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of the letters' words, as codes, and their counts.

    Words are runs of letters in lower case, with a blank on either side; a
    code holds up to three code points of 21 bits.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_letters()[points], points, _BLANK)
    points = np.concatenate([[_BLANK], points, [_BLANK]]).astype(np.uint64)
    keep = (points != _BLANK) | np.concatenate([[True], points[:-1] != _BLANK])
    p = points[keep]
    if len(p) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.uint64(21)
    two = (p[:-1] << s) | p[1:]
    three = (two[:-1] << s) | p[2:]
    codes = np.concatenate([p[p != _BLANK], two, three[p[1:-1] != _BLANK]])
    codes.sort()
    first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes, ties by code."""
    if len(counts) > 4 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:n]]


@dataclass(frozen=True)
class Profiles:
    """All profile codes, sorted, and each language's rank of each (``n`` where absent)."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    n: int

    def predict(self, text: str) -> tuple[str, float]:
        """The language of least out-of-place distance, and 1 - that distance as a share of the greatest."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        mine = top(codes, counts, self.n)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        known = self.codes[at] == mine
        theirs = np.where(known, self.ranks[:, at], self.n)
        apart = np.where(theirs < self.n, np.abs(theirs - np.arange(len(mine))), self.n).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.n * len(mine)))


def profiles_of(rows: dict[str, tuple[np.ndarray, np.ndarray]], n: int = PROFILE) -> Profiles:
    """Profiles from each language's codes and counts."""
    langs = sorted(rows)
    tops = [top(c[o], k[o], n) for c, k in (rows[x] for x in langs) for o in [np.argsort(c)]]
    codes = np.unique(np.concatenate([*tops, np.zeros(0, np.uint64)]))
    ranks = np.full((len(langs), len(codes)), n, dtype=np.int64)
    for i, t in enumerate(tops):
        ranks[i, np.searchsorted(codes, t)] = np.arange(len(t))
    return Profiles(langs, codes, ranks, n)


def train(docs: DataFrame, n: int = PROFILE, sample: int | None = SAMPLE) -> Profiles:
    """Profiles of the values of ``lang``, each from about ``sample`` whole documents at most (None: from all).

    Rows with null lang, text or doc_id teach nothing. Counts are summed in
    Spark; a few times ``n`` n-grams a language come to the driver.
    """
    prepare(docs.sparkSession)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    taught = taught.where("doc_id is not null and lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        taken = 0

        def merged() -> int:
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                held[lang] = [(codes, np.bincount(at, np.concatenate([k for _, k in parts]), len(codes)).astype(np.int64))]
            return sum(len(c) for parts in held.values() for c, _ in parts)

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, [(codes, times)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(times)], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(text)
                held.setdefault(lang, []).append(grams)
                taken += 1 + len(grams[0])
                if taken > HELD:
                    taken = merged()
                    if taken > HELD // 2:  # few are the same: Spark adds up the rest
                        yield from counts()
                        taken = 0
        merged()
        yield from counts()

    with Steps(docs.sparkSession) as steps:
        chosen = taught
        if sample is not None:
            sizes = docs.where("doc_id is not null and lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count()
            share = steps.write(sizes.select("lang", F.least(F.lit(1.0), sample / F.col("count")).alias("share")), "shares")
            few = share.limit(LANGS + 1).count() <= LANGS
            part = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            chosen = taught.join(F.broadcast(share) if few else share, "lang").where(part < F.col("share"))
        counted = chosen.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        order = W.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(_SPREAD))).orderBy(F.desc("n"), "code")
        kept = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("lang", "code", "n")
        got = kept.toPandas()  # languages x _SPREAD x n rows at most
    return profiles_of({str(lang): (g["code"].to_numpy().astype(np.int64).view(np.uint64), g["n"].to_numpy()) for lang, g in got.groupby("lang")}, n)


def prediction(profiles: Profiles):
    """A column function text -> struct(lang_pred, score), over the whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    def column(name: str = "text") -> Column:
        return predict(text_of(name))

    return column


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score, a row a row.

    ``und`` with score 0 if the text is null or has no letter (or no language
    was learned). A null doc_id stays; repeated rows stay; other columns are not
    read; an empty table gives an empty result. Ties go to the least name.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", prediction(profiles)().alias("p")).select("doc_id", "p.lang_pred", "p.score")
