"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare, text_of

#: Labelled documents that a model is fitted on at most: those of least xxhash64(doc_id).
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST_LEAF, L2 = 64, 80, 4, 0.15, 8, 1.0

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 full
#: stop, 7 comma, 8 exclamation or question mark, 9 bar, 10 other ASCII mark, 11 non-ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 11
for _bytes, _kind in ((b" \t", 4), (b"\n\r\x0b\x0c", 5), (b".", 6), (b",", 7), (b"!?", 8), (b"|", 9)):
    _CLASS[list(_bytes)] = _kind
FEATURES = 20


def statistics(text: str) -> list[float]:
    """Statistics of the whole text; all 0 for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * FEATURES
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=12) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        *share[1:].tolist(),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        np.log1p(max(map(len, words), default=0)),
        len(set(words)) / n,
        len(pairs) / max(1, n - 1),
        len(set(lines)) / m,
        np.log1p(len(raw) / m),
        np.log1p(max(map(len, lines), default=0)),
        float(share[1] / max(1e-9, share[1] + share[2])),
    ]


@dataclass(frozen=True)
class Trees:
    """Trees of equal depth, flattened: node ``i`` has the children 2i+1 and 2i+2.

    ``feature`` and ``cut`` have a row per tree and a column per inner node,
    ``leaf`` a column per leaf. A row goes right where its value is above the cut.
    """

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all trees at a time."""
        trees, inner = self.feature.shape
        if not len(x) or not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        node = np.zeros((len(x), trees), dtype=np.int64)
        which, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[which, node]] > self.cut[which, node])
        raw = self.prior + self.leaf[which, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of logistic loss over binned columns.

    Without rows the prior is even; with one class only, the trees stay at the prior.
    """
    n, inner, leaves = len(y), 2**DEPTH - 1, 2**DEPTH
    rate = (y.sum() + 0.5) / (n + 1)
    prior = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(n, prior)
    features, at, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            local = node - base
            best = np.full(width, 1e-6)
            cut_bin = np.full(width, BINS)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * BINS + binned[:, f]
                gs, hs, ns = (np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (g, h, None))
                gl, hl, nl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], ns.cumsum(1)[:, :-1]
                gt, ht, nt = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True), ns.sum(1, keepdims=True)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = (top > best) & (k < len(c))
                best[better], cut_bin[better] = top[better], k[better]
                feature[base : base + width][better] = f
                cut[base : base + width][better] = c[k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        local = node - inner
        value = -RATE * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + L2)
        raw += value[local]
        features.append(feature)
        at.append(cut)
        leaf.append(value)
    return Trees(prior, np.stack(features), np.stack(at), np.stack(leaf))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled documents, chosen by hash of the id.

    Only their statistics come to the driver. Rows of ``labels`` with a null
    doc_id or quality teach nothing; of repeated ids the greatest label counts,
    and of texts that share an id the one of least hash, so the bound holds for rows.
    Without labelled documents every score is the even prior.
    """
    prepare(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hashed = texts.join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id").withColumn("mark", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["doc_id", "x", "quality", "mark"])

    measured = hashed.select("doc_id", "text", "quality", "mark").mapInArrow(run, "doc_id long, x array<double>, quality int, mark long")
    got = measured.groupBy("doc_id").agg(F.min_by(F.struct("x", "quality"), "mark").alias("one")).select("doc_id", "one.*").toPandas()
    got = got.sort_values("doc_id")
    x = np.array([list(v) for v in got["x"]], dtype=float).reshape(-1, FEATURES)
    return fit(x, (got["quality"].to_numpy() == 1).astype(float))


def score_column(model: Trees):
    """A column function text -> score in 0..1, over the whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, FEATURES)
        return pd.Series(model.score(x))

    return lambda name="text": score(text_of(name))


def classify(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold, else 0), a row a row.

    A null text scores as an empty one; a null doc_id stays; repeated rows stay;
    other columns are not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    scored = docs.select("doc_id", score_column(model)().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
