"""Packing of documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import ENCODE_BYTES, joined, prepare, stored, text_of
from larkspur.llm.encoding import encoder

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 1024
END_ID = 0
#: Ranks within a length are numbered in this many hashed parts, so that a
#: length that a third of all pieces share is no single group.
PARTS = 256
#: Column generation ends when padding is below this share, or after so many columns.
SLACK = 1e-3
COLUMNS = 400

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Plan:
    """Where the items of each length go, as runs of ranks.

    The items of length ``length`` and rank ``first <= rank < first + n`` fill
    sequences from ``sequence`` on, ``each`` to a sequence, from ``offset`` on.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of items by length and rank within the length."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = 1 << 40
        at = np.searchsorted(self.length * wide + self.first, lengths * wide + ranks, side="right") - 1
        k = ranks - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + (k % self.each[at]) * lengths


def best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth that fits: unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            value = best[c - sizes[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], took[c] = value[k], k
    pattern = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns, uses and the patterns' inverse to start from: fill with the
    longest that fits, and use the filling until one of its lengths runs out.
    That length is in no later filling, so in the order of running out the
    patterns are a triangular matrix, whose inverse is found by substitution
    (threaded linear algebra on the driver is not needed for it)."""
    m = len(sizes)
    order: list[int] = []
    columns, used, left = np.diag((capacity // sizes).astype(float)), np.zeros(m), demand.astype(float)
    while (alive := np.nonzero(left > 1e-9)[0]).size:
        room, pattern = capacity, np.zeros(m)
        for k in alive[::-1]:
            if room < sizes[alive[0]]:
                break
            n = min(max(1, int(left[k])), room // int(sizes[k]))
            pattern[k], room = n, room - n * int(sizes[k])
        have = np.nonzero(pattern)[0]
        times = left[have] / pattern[have]
        out = have[int(times.argmin())]
        left[have] -= pattern[have] * times.min()
        left[out], columns[:, out], used[out] = 0, pattern, times.min()
        order += [int(out), *(int(k) for k in have if k != out and left[k] < 1e-9)]
        left[left < 1e-9] = 0
    inverse = np.zeros((m, m))
    for k in order:  # row k of columns times inverse is a unit row
        row = np.zeros(m)
        row[k] = 1
        for j in np.nonzero(columns[k])[0]:
            if j != k:
                row -= columns[k, j] * inverse[j]
        inverse[k] = row / columns[k, k]
    return columns, used, inverse


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, from the linear program
    "least number of sequences that hold exactly the demand"."""
    m = len(sizes)
    columns, used, inverse = first_basis(sizes, demand, capacity)
    least = float(sizes @ demand) / capacity
    for _ in range(COLUMNS):
        if used.sum() <= least * (1 + SLACK):
            break
        worth = inverse.sum(axis=0)
        value, pattern = best_column(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        some = np.nonzero(pattern)[0]
        step = (inverse[:, some] * pattern[some]).sum(axis=1)
        up = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / step[up]
        out = int(ratio.argmin())
        t = ratio[out]
        used = np.maximum(used - t * step, 0)
        used[out] = t
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= np.outer(step, inverse[out])
        columns[:, out] = pattern
    return columns, used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Turn the counts of item lengths into runs of ranks for whole sequences.

    Patterns are used as often as the linear program says, rounded down; what
    is left, at most a few thousand items whatever the input, goes best-fit
    decreasing. Work and memory depend on the capacity, not on the input.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    bins: dict[tuple, int] = {}
    left = demand.copy()
    if len(sizes):
        columns, used = solve(sizes, demand.astype(float), capacity)
        for j in range(len(sizes)):
            counts = np.rint(columns[:, j]).astype(np.int64)
            if not counts.any():
                continue
            have = counts > 0
            times = min(int(np.floor(used[j] + 1e-6)), int((left[have] // counts[have]).min()))
            if times > 0:
                left -= counts * times
                key = tuple((int(k), int(counts[k])) for k in np.nonzero(counts)[0])
                bins[key] = bins.get(key, 0) + times
    for key in best_fit(sizes, left, capacity):
        bins[key] = bins.get(key, 0) + 1
    runs: list[tuple[int, int, int, int, int]] = []
    rank = np.zeros(len(sizes), dtype=np.int64)
    sequence = 0
    for key, times in bins.items():
        offset = 0
        for k, each in key:
            runs.append((int(sizes[k]), int(rank[k]), sequence, each, offset))
            rank[k] += each * times
            offset += each * int(sizes[k])
        sequence += times
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, n_sequences=sequence)


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Iterator[tuple]:
    """Fill a sequence at a time: the longest item left, then the longest that still fits.

    Equal fillings are repeated while all their items last.
    """
    left = counts.copy()
    while left.any():
        room, key = capacity, {}
        k = len(sizes) - 1
        while k >= 0 and room >= sizes[0]:
            n = min(int(left[k]) - key.get(k, 0), room // int(sizes[k]))
            if n > 0:
                key[k] = key.get(k, 0) + n
                room -= n * int(sizes[k])
            k = min(k, int(np.searchsorted(sizes, room, side="right"))) - 1
        times = min(int(left[k]) // n for k, n in key.items())
        for k, n in key.items():
            left[k] -= n * times
        for _ in range(times):
            yield tuple(sorted(key.items()))


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: full ones of ``capacity`` ids, then the rest."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, ENCODE_BYTES):
            with encoder(path, keep_ids=True) as made:
                ids, at = made.ids(batch.column(1), END_ID)
            n = np.diff(at)
            each = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
            length = np.minimum(capacity, n[row] - start)
            held = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(held[4 * s : 4 * (s + k)]) for s, k in zip((at[row] + start).tolist(), length.tolist(), strict=True)]
            doc = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids.

    A document is its ids and then ``END_ID``; it is cut every ``capacity`` ids.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Full pieces are sequences of their own; the rest is a
    cutting-stock problem over at most ``capacity`` lengths, solved on the
    driver from the length histogram alone. Pieces of one length are ranked by
    hashed part, doc_id and start, so reruns agree.

    A null or empty text is the one id that ends it; a null doc_id stays null;
    repeated rows are packed each; an empty table gives no piece.
    """
    pieces = stored(cut(docs, path, capacity), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = pieces.groupBy("length", "part").count().toPandas()  # at most capacity x PARTS rows
    offsets = np.zeros((capacity + 1, PARTS), dtype=np.int64)
    np.add.at(offsets, (counts["length"].to_numpy(dtype=np.int64), counts["part"].to_numpy(dtype=np.int64)), counts["count"].to_numpy(dtype=np.int64))
    totals = offsets.sum(axis=1)
    made = plan({int(s): int(totals[s]) for s in np.nonzero(totals)[0]}, capacity)
    offsets = np.cumsum(offsets, axis=1) - offsets
    order = W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length = frame["length"].to_numpy(dtype=np.int64)
            rank = offsets[length, frame["part"].to_numpy(dtype=np.int64)] + frame["rank"].to_numpy(dtype=np.int64) - 1
            sequence, offset = made.place(length, rank)
            yield frame.drop(columns=["part", "rank"]).assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(run, f"{_PIECES}, sequence_id long, offset long")
