"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps shingles to 64 bits; a document's sketch is its ``K``
least hashes. Inverted lists of the sketch values yield candidates, the sketch
of a pair's union estimates its Jaccard similarity, and full sets decide.

Two documents of similarity 0.8 share, of the 32 least values of their union,
26 in the mean with a deviation of 2.3, so fewer than ``SHARED`` = 12 about three
times in 10^8 pairs. Hence each document may leave its ``SHARED`` - 1 most frequent
values out of the lists (the pair's rarest common value is in neither's part),
and with them the passages and lines that many documents share.

Pairs never leave a task. What the estimate lets through joins documents to
families, given out as a spanning forest: no more rows than documents. Then the
full sets of a family meet, once, in blocks of bounded bytes, where they are
compared exactly, and again only a forest of the links goes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import Steps, components, perhaps, prepare, text_of

WORDS, PERCENT = 5, 80
K, SHARED = 32, 12
#: ``SHARED`` is made for this percent and holds above it; below it, pairs must
#: share fewer (:func:`shared_at_least`).
FITTED = 80
#: Documents of a list that are compared by their sketches. A longer list makes
#: all its documents one family, unseen: that only gives the exact step more to do.
LIST = 2048
#: Pairs of lists up to this long are tested together; in longer ones some
#: members lead first.
SHORT = 32
#: Bytes of full sets and documents that are compared in one task; larger
#: families are split into blocks.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 4096
#: Documents of a family, or of a list, that are held against all others first.
LEADERS = 8
#: Pairs tested at once.
_PAIRS = 1 << 14

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
_NONE = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending, as signed 64-bit.

    A-Z are lower-cased and words split at ASCII white space; a text of fewer
    words is one shingle, a text without words has none.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        odd = _ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD)))
        out += h[i : len(h) - n + 1 + i] * odd
    return np.unique(_mixed(out).view(np.int64))


def mark_of() -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(text_of()).alias("mark")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark (hash of the text), n (shingles), set_id (128-bit digest of the set,
    null if empty) and least (the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            least = _lists([s[:K] for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), ids, least], names=["doc_id", "mark", "n", "set_id", "least"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(), text_of().alias("text")).mapInArrow(run, "doc_id long, mark long, n long, set_id binary, least array<long>")


def _binomial_below(k: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


@cache
def shared_at_least(percent: int) -> int:
    """How many of the ``K`` least values of their union a pair must share.

    ``SHARED`` from ``FITTED`` percent on; below, the most that a pair of that
    similarity misses no more often than one of ``FITTED``.
    """
    if percent >= FITTED:
        return SHARED
    often = _binomial_below(SHARED, K, FITTED / 100)
    found = max(k for k in range(SHARED + 1) if _binomial_below(k, K, percent / 100) <= often)
    if not found:
        raise ValueError(f"percent {percent} is too low for sketches of {K} hashes")
    return found


# Inside a task: runs of equal keys, links as a forest.


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal leading ``keys`` columns, and where each run starts, and the end.

    Rows come sorted by the keys; a run that the batch's end may cut waits for the next batch.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            new |= column[1:] != column[:-1]
        return np.concatenate([[0], np.nonzero(new)[0] + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        same = held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[batch.num_rows - 1] for k in range(keys))
        held.append(batch)
        if same:
            continue
        table = pa.Table.from_batches(held)
        starts = cut(table)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), starts
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(cut(table), table.num_rows)


class Forest:
    """A growing partition of numbers into trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def roots(self, xs: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, xs.tolist()), dtype=np.int64, count=len(xs))

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two trees."""
        out = []
        for pair in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(pair[0]), self.root(pair[1])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                out.append(pair)
        return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and where each list starts, and the end."""
    array = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = array.offsets.to_numpy()
    return array.flatten().to_numpy(), offsets - offsets[0]


def _sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows of ``K`` values, short ones filled with the largest."""
    values, starts = _flat(column)
    n = np.diff(starts)
    out = np.full((len(n), K), _NONE)
    out[np.arange(K)[None, :] < n[:, None]] = values
    return out


def _estimated(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (i, j) share enough of the ``K`` least values of their union, and are of sizes that allow a link."""
    good = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
    least = shared_at_least(percent)
    at = np.nonzero(good)[0]
    for some in np.split(at, range(_PAIRS, len(at), _PAIRS)):
        values = np.sort(np.concatenate([sketch[i[some]], sketch[j[some]]], axis=1), axis=1)
        real = values[:, 1:] != _NONE
        twice = (values[:, 1:] == values[:, :-1]) & real
        order = 1 + np.cumsum(real & ~twice, axis=1, dtype=np.int16)  # of each value among the distinct ones
        shared = (twice & (order <= K)).sum(axis=1)
        good[some] = shared * K >= np.minimum(order[:, -1], K) * least
    return good


def _candidates(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that share a list and pass the estimate.

    Rows (value, id, n, least) come sorted by value. Trees are kept for the whole
    partition, so pairs that are joined already are not tested.
    """
    trees = Forest()
    for table, starts in whole_runs(batches, 1):
        ids, n, sketch = table.column(1).to_numpy(), table.column(2).to_numpy(), _sketch_rows(table.column(3))
        found: list[tuple[int, int]] = []

        def tested(i: np.ndarray, j: np.ndarray) -> None:
            roots = trees.roots(ids)
            for part in range(0, len(i), _PAIRS):
                x, y = i[part : part + _PAIRS], j[part : part + _PAIRS]
                if part:
                    roots = trees.roots(ids)
                apart = roots[x] != roots[y]
                x, y = x[apart], y[apart]
                good = _estimated(sketch, n, x, y, percent)
                found.extend(trees.link(ids[x[good]], ids[y[good]]))

        m = np.diff(starts)
        first = np.repeat(starts[:-1], m - 1)
        others = np.delete(np.arange(table.num_rows), starts[:-1])
        tested(first, others)
        short = [np.zeros((2, 0), np.int64)]
        for size in np.unique(m[(m > 2) & (m <= SHORT)]):
            i, j = np.triu_indices(size - 1, 1)
            of = starts[:-1][m == size][:, None] + 1
            short.append(np.stack([(of + i).ravel(), (of + j).ravel()]))
        tested(*np.concatenate(short, axis=1))
        for at, size in zip(starts[:-1][m > SHORT].tolist(), m[m > SHORT].tolist(), strict=True):
            mine = np.arange(at, at + size)
            for lead in range(at + 1, at + LEADERS):
                tested(np.full(size - 1, lead), np.delete(mine, lead - at))
            _, tree, members = np.unique(trees.roots(ids[mine]), return_inverse=True, return_counts=True)
            for row in mine[tree != members.argmax()]:
                tested(np.full(size - 1, row), np.delete(mine, row - at))
        yield _edges(found)


def _links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of a block whose full sets are similar.

    Rows (family, i, j, side, id, component, set) come sorted by family, i, j, the
    block; pairs of one component are joined already. If a block has two sides,
    only pairs across them are compared.
    """
    for table, starts in whole_runs(batches, 3):
        side, ids, component = (table.column(k).to_numpy() for k in (3, 4, 5))
        values, at = _flat(table.column(6))
        found: list[tuple[int, int]] = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s > 1:
                found += _block_links(ids[s:e], component[s:e], side[s:e], values[at[s] : at[e]], at[s : e + 1] - at[s], percent)
        yield _edges(found)


def _block_links(ids: np.ndarray, component: np.ndarray, side: np.ndarray, values: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    m, n = len(ids), np.diff(at)
    trees = Forest()
    trees.parent = dict(zip(ids.tolist(), component.tolist(), strict=True))
    two = side.any() and not side.all()
    if m == 2:
        a, b = values[: at[1]], values[at[1] :]
        same = component[0] == component[1] or min(n) * 100 < max(n) * percent
        common = 0 if same else np.intersect1d(a, b, assume_unique=True).size
        return trees.link(ids[:1], ids[1:]) if common and common * 100 >= percent * (n.sum() - common) else []

    owner = np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    held = values[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])
    opens = np.nonzero(new)[0]  # where the holders of a value start
    holders = np.diff(np.append(opens, len(held)))
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    by_value = owner[order]

    def overlaps(row: int) -> np.ndarray:
        """How many values each document shares with that of the row."""
        mine = which[at[row] : at[row + 1]]
        mine = mine[holders[mine] > 1]
        count = holders[mine]
        where = np.repeat(opens[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(by_value[where], minlength=m)

    found: list[tuple[int, int]] = []

    def held_against_all(row: int) -> None:
        common = overlaps(row)
        good = (common > 0) & (common * 100 >= percent * (n[row] + n - common))
        if two:
            good &= side != side[row]
        good[row] = False
        near = np.nonzero(good)[0]
        found.extend(trees.link(np.repeat(ids[row : row + 1], len(near)), ids[near]))

    popular = np.argsort(-np.bincount(owner, weights=holders[which], minlength=m) / np.maximum(n, 1), kind="stable")
    asked = set()
    for _ in range(LEADERS):
        roots = trees.roots(ids)
        names, tree, members = np.unique(roots, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return found
        row = next((int(r) for r in popular if r not in asked and (not asked or tree[r] != members.argmax())), None)
        if row is None:
            break
        asked.add(row)
        held_against_all(row)
    _, tree, members = np.unique(trees.roots(ids), return_inverse=True, return_counts=True)
    if len(members) > 1:
        for row in np.nonzero(side == 0 if two else tree != members.argmax())[0].tolist():
            if row not in asked:
                held_against_all(row)
    return found


# The plan.


def inverted(classes: DataFrame, percent: int) -> DataFrame:
    """id, doc_id, mark, n, least, weight (of how many lists' members in all) and kept, the
    values under which a class stands in the inverted lists.

    Values of a single holder are in no list; of the others, each class leaves
    out its most frequent ones.
    """
    flat = classes.select("id", F.explode("least").alias("value"))
    lists = flat.groupBy("value").agg(F.count("id").alias("holders")).where("holders > 1")
    entry = F.struct((-F.col("holders")).alias("fewer"), "value").alias("entry")
    shared = flat.join(lists, "value").select("id", entry).groupBy("id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))  # K at most
    spare = F.least(F.floor((F.col("n") * percent + 99) / 100) - 1, F.lit(shared_at_least(percent) - 1)).cast("int")
    both = shared.join(classes, "id")
    weight = -F.aggregate("entries.fewer", F.lit(0).cast("long"), lambda total, x: total + x)
    kept = F.slice(F.col("entries.value"), spare + 1, F.lit(K))
    return both.select("id", "doc_id", "mark", "n", "least", weight.alias("weight"), kept.alias("kept")).where(F.size("kept") > 0)


def families(lists: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """id, component: the classes that candidate pairs connect."""
    entries = lists.select("id", F.explode("kept").alias("value"))
    long = steps.write(entries.groupBy("value").agg(F.count("id").alias("m"), F.min("id").alias("leader")).where(F.col("m") > LIST), "long")
    rows = lists.select(F.explode("kept").alias("value"), "id", "n", "least").join(long.select("value"), "value", "left_anti")
    dealt = rows.repartition("value").sortWithinPartitions("value")
    near = dealt.mapInArrow(lambda batches: _candidates(percent, batches), "a long, b long")
    whole = entries.join(long, "value").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    return components(near.union(whole), steps=steps)


def sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """family, blocks, own, id, set: the full sets of the members, one for each id.

    Only the texts that the bitmap lets through are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(), text_of().alias("text"))
    texts = perhaps(rows, members, ["doc_id", "mark"]).where("maybe").select("doc_id", "mark", "text").dropDuplicates(["doc_id", "mark"])
    texts = texts.join(members, ["doc_id", "mark"]).select("family", "blocks", "own", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _lists([shingles(t, words) for t in batch.column(4).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["family", "blocks", "own", "id", "set"])

    return texts.mapInArrow(run, "family long, blocks long, own long, id long, set array<long>")


def _blocks(size: str = "n") -> Column:
    """The blocks that the documents of a group need, by shingles and by number."""
    return F.ceil(F.greatest(F.sum(size) * 8 / BLOCK_BYTES, F.count(size) / BLOCK_DOCS)).cast("long")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    rows = rows.select("family", "i", "j", "side", "id", "component", "set")
    dealt = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(lambda batches: _links(percent, batches), "a long, b long")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int, steps: Steps) -> DataFrame:
    """Edges (a, b) that connect all similar classes, fewer than there are classes in any block.

    A family of one block is compared there. The documents of a larger one are
    dealt to blocks, with its most popular members in each, which join a group of
    near copies to them; then those that are not in the family's largest
    component are held against all of the family, block by block.
    """
    lists = steps.write(inverted(classes, percent), "inverted")
    found = families(lists, percent, steps)
    members = steps.write(found.withColumnRenamed("component", "family").join(lists.select("id", "doc_id", "mark", "n", "weight"), "id"), "members")
    steps.delete(lists, found)
    large = steps.write(members.groupBy("family").agg(_blocks().alias("blocks")).where("blocks > 1"), "large")
    placed = members.join(large, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    sets = sets_of(docs, placed, words)
    zero, alone = F.lit(0).cast("long"), F.col("id").alias("component")
    split = not large.isEmpty()
    if split:
        sets = steps.write(sets, "sets")
    rows = sets.select("family", F.col("own").alias("i"), zero.alias("j"), F.lit(0).alias("side"), "id", alone, "set")
    if not split:
        return steps.write(_compared(rows, percent), "links")
    order = W.partitionBy("family").orderBy(F.desc("weight"), "id")
    leaders = members.join(large, "family").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS).select("id")
    every = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i")
    sent = sets.join(leaders, "id", "left_semi").select("family", every, "own", "id", "set").where("i <> own")
    sent = sent.select("family", "i", zero.alias("j"), F.lit(0).alias("side"), "id", alone, "set")
    first = steps.write(_compared(rows.union(sent), percent), "links")
    joined = components(first, steps=steps)
    state = placed.where("blocks > 1").select("family", "id", "n", "blocks", "own").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = steps.write(state, "state")
    sizes = state.groupBy("family", "component").count().groupBy("family").agg(F.max(F.struct("count", "component")).alias("top"))
    rest = state.join(sizes.select("family", F.col("top.component").alias("main")), "family").where("component <> main")
    parts = rest.groupBy("family").agg(_blocks().alias("parts"))
    rest = rest.join(parts, "family").select("id", "family", "component", "blocks", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).alias("i"))
    every = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j")
    some = rest.select("id", "family", "component", "i", every, F.lit(0).alias("side"))
    whole = state.join(parts, "family").select("id", "family", "component", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    across = some.union(whole.select(*some.columns)).join(sets.select("id", "set"), "id")
    return first.union(steps.write(_compared(across, percent), "links"))


def classified(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs`` and, a row per distinct set, set_id, first (whether the
    class comes first in its component) and doc_id, mark and component_id, the least doc_id.

    Each set has a number of its own, as a doc_id may repeat with other texts.
    """
    with Steps(docs.sparkSession) as steps:
        prints = steps.write(fingerprints(docs, words), "prints")
        usable = prints.where("n > 0 and doc_id is not null")
        one = F.min(F.struct("doc_id", "mark", "n", "least"))
        classes = usable.groupBy("set_id").agg(one.alias("one")).select(F.monotonically_increasing_id().alias("id"), "set_id", "one.*")
        classes = steps.write(classes, "classes")
        found = components(links(docs, classes, words, percent, steps), steps=steps)
        slim = classes.select("id", "set_id", "doc_id", "mark")
        least = F.min(F.struct("doc_id", "mark", "id")).alias("least")
        roots = slim.join(found, "id").groupBy("component").agg(least)
        of_class = slim.join(found.join(roots, "component").select("id", "least"), "id", "left")
        of_class = of_class.select("set_id", "doc_id", "mark", F.coalesce("least.id", "id").eqNullSafe(F.col("id")).alias("first"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))
        slim_prints = steps.write(prints.select("doc_id", "mark", "n", "set_id"), "prints")
        return steps.keep(slim_prints), steps.keep(steps.write(of_class, "components"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``.

    component_id is the least doc_id that a chain of links reaches, kept is
    doc_id = component_id. Documents of equal sets are one class and need no
    pair. A null text, or one without words, has 0 shingles and links with
    nothing; a null doc_id is a component of its own (component_id null, kept
    true); rows that repeat an id with another text are documents of their own
    that share a name; an empty table gives an
    empty result; other columns are not read; a text of any length is read
    whole. A ``percent`` too low for the sketches (:func:`shared_at_least`)
    raises ValueError.
    """
    prepare(docs.sparkSession)
    prints, classes = classified(docs, words, percent)
    usable = prints.where("n > 0 and doc_id is not null")
    linked = usable.select("doc_id", "n", "set_id").join(classes.select("set_id", "component_id"), "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = prints.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row of ``docs`` for each group of near duplicates, that of least doc_id, all columns as they are.

    Of rows that repeat a doc_id and its text one stays; with another text, that
    copies nothing, both stay. Rows with a null doc_id all stay, and so does a
    row without words for each doc_id. Columns of any name pass untouched.
    Rows that the bitmap clears of being a copy are not shuffled.
    """
    prepare(docs.sparkSession)
    prints, classes = classified(docs, words, percent)
    named = prints.where("doc_id is not null")
    kept = classes.where("first").select("doc_id", "mark").union(named.where("n = 0").select("doc_id", "mark")).distinct().withColumn("stays", F.lit(True))
    keys = named.groupBy("doc_id", "mark").agg(F.count("n").alias("rows")).join(kept, ["doc_id", "mark"], "left")
    doubtful = keys.select("doc_id", "mark", F.coalesce("stays", F.lit(False)).alias("stays"), "rows").where("not stays or rows > 1").select("doc_id", "mark", "stays")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(), row)
    seen = perhaps(given, doubtful, ["doc_id", "mark"])
    clear = seen.where("doc_id is null or not maybe").select("row")
    one = F.first("row") if "map<" in docs.schema.simpleString() else F.min("row")
    checked = seen.where("doc_id is not null and maybe").groupBy("doc_id", "mark").agg(one.alias("row"))
    checked = checked.join(doubtful, ["doc_id", "mark"], "left").where("coalesce(stays, true)").select("row")
    return clear.union(checked).select("row.*")
