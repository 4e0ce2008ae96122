"""Near-duplicate vectors: an exact metric range join.

The metric is the angle. Pivots partition the vectors into cells of the nearest
pivot. If x (home h) and y (home c) are within the angle r, the triangle
inequality gives angle(x, p_c) <= angle(x, p_h) + 2r and angle(x, p_c) <=
radius(c) + r. y lies on p_c's side of the plane between p_h and p_c, so by chords
x is no farther from that plane than from y: (|x p_c|^2 - |x p_h|^2) / (2 |p_h p_c|)
<= the chord of r. Where all three hold, x also goes to cell c, for c < h only, so
each pair meets once. Cells are joined independently, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Steps, components, prepare

COSINE = 0.9
#: Vectors of a cell in the mean, vectors of a block, and pivots at most.
CELL, BLOCK, PIVOTS = 2048, 2048, 4096
#: Rows of an Arrow batch of vectors that go to several cells.
SLICE = 4096
_ROWS = 256
_EPS = 1e-6


def usable(vector: str = "embedding", key: str = "vec_id") -> Column:
    """Not null, not empty, not zero, all components finite, and an id."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaling first keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray | pa.LargeListArray) else pa.chunked_array(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _pairs(left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of cosine >= ``cosine``, some rows at a time.

    Single precision sorts out; where its error could matter, double decides.
    """
    margin = 1e-6 + 4e-7 * left.shape[1]
    single_l, single_r = left.astype(np.float32), right.astype(np.float32).T
    for start in range(0, len(left), _ROWS):
        s = single_l[start : start + _ROWS] @ single_r
        i, j = np.nonzero(s >= cosine - margin)
        if same:
            up = i + start < j
            i, j = i[up], j[up]
        near = s[i, j] < cosine + margin
        i += start
        if near.any():
            exact = np.einsum("ij,ij->i", left[i[near]], right[j[near]]) >= cosine
            keep = np.ones(len(i), dtype=bool)
            keep[np.nonzero(near)[0][~exact]] = False
            i, j = i[keep], j[keep]
        yield i, j


def _join_block(cosine: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = key[0].as_py()
        ids, weight, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        x = unit(matrix(table.column("v").combine_chunks(), width))
        first, second = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        same = not len(second)
        other = first if same else second
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i, j in _pairs(x[first], x[other], cosine, same):
            i, j = first[i], other[j]
            links += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            while len(i) and (label[i] != label[j]).any():
                least = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], least)
                np.minimum.at(label, label[j], least)
                label = label[label]
        while (label[label] != label).any():
            label = label[label]
        hit = links > 0
        return pa.table({"id": ids[hit], "links": links[hit], "root": ids[label[hit]]})

    return run


def range_join(classes: DataFrame, cosine: float, steps: Steps) -> DataFrame:
    """id, links, root: for distinct vectors (id, n, v) the links found in each
    block, each weighing ``n``, and another id that is connected with it there.

    No pair leaves a block: a block sends at most a row per vector. Pivots are
    at most ``PIVOTS`` vectors of least hashed id; larger cells only have more
    blocks. Vectors of different lengths don't meet.
    """
    reach = math.acos(cosine)
    sized = classes.withColumn("width", F.size("v"))
    total = sized.count()
    n = max(1, min(PIVOTS, math.ceil(total / CELL)))
    taken = sized.orderBy(F.xxhash64("id"), "id").limit(n).select("width", "v").collect()
    pivots: dict[int, np.ndarray] = {}
    for width in {r["width"] for r in taken}:
        pivots[width] = unit(np.array([r["v"] for r in taken if r["width"] == width], dtype=np.float64))

    def angles(x: np.ndarray) -> np.ndarray:
        p = pivots.get(x.shape[1], np.eye(1, x.shape[1]))
        return np.arccos(np.clip(unit(x) @ p.T, -1, 1))

    def by_width(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            yield part, angles(matrix(part.column("v"), int(width)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, a in by_width(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a.argmin(axis=1), pa.int32()), pa.array(a.min(axis=1))], names=["id", "n", "v", "width", "home", "angle"])

    kind = dict(classes.dtypes)["v"]
    placed = steps.write(sized.select("id", "n", "v", "width").mapInArrow(homes, f"id long, n long, v {kind}, width int, home int, angle double"), "homes")
    radii = {(r["width"], r["home"]): (r["radius"], r["held"]) for r in placed.groupBy("width", "home").agg(F.max("angle").alias("radius"), F.count("id").alias("held")).collect()}

    chord = 2 * math.sin(reach / 2)

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, a in by_width(batch):
                width, home = part.column("width")[0].as_py(), part.column("home").to_numpy()
                radius = np.array([radii.get((width, c), (-9.0, 0))[0] for c in range(a.shape[1])])
                own = a[np.arange(len(a)), home][:, None]
                near = (a <= own + 2 * reach + _EPS) & (a <= radius + reach + _EPS)
                p = pivots.get(width, np.eye(1, width))
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
                near &= 2 * np.cos(own) - 2 * np.cos(a) <= 2 * apart * (chord + _EPS) + _EPS
                near[np.arange(len(a)), home] = True
                near &= np.arange(a.shape[1])[None, :] <= home[:, None]
                row, cell = np.nonzero(near)
                for top in range(0, len(row), SLICE):  # a vector may go to every cell
                    r, c = row[top : top + SLICE], cell[top : top + SLICE]
                    some = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*(some.column(k) for k in ("id", "n", "v", "width")), pa.array(c, pa.int32()), pa.array(c != home[r])], names=["id", "n", "v", "width", "cell", "guest"])

    spread = placed.mapInArrow(guests, f"id long, n long, v {kind}, width int, cell int, guest boolean")
    counts = spread.groupBy("width", "cell").agg(F.count_if("guest").alias("g"), F.count_if(~F.col("guest")).alias("h"))
    counts = counts.select("width", "cell", F.greatest(F.lit(1), F.ceil(F.col("h") / BLOCK)).cast("int").alias("hb"), F.ceil(F.col("g") / BLOCK).cast("int").alias("gb"))
    shapes = F.broadcast(counts)  # at most PIVOTS rows a width
    dealt = spread.join(shapes, ["width", "cell"])
    own = F.when(F.col("guest"), F.col("hb") + F.pmod(F.xxhash64("id"), F.greatest("gb", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("hb"))).cast("int")
    dealt = dealt.withColumn("own", own)
    meets = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("hb") - 1)).otherwise(F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1))
    dealt = dealt.withColumn("other", F.explode(meets))
    keyed = dealt.select("width", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "v", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return keyed.groupBy("width", "cell", "i", "j").applyInArrow(_join_block(cosine), "id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors``.

    Links join rows of cosine >= ``cosine`` (computed in double precision).
    Equal vectors are one class, joined once under a number of its own; ids only
    name the components. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows with a null id, link with
    nothing: n_links 0, component_id their own id. Rows that repeat an id are
    rows of their own; other columns are not read; an empty table gives an empty
    result.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), usable(vector, key).alias("ok"))
    good = rows.where("ok").select("vec_id", "v")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("vec_id").alias("n"))
    with Steps(vectors.sparkSession) as steps:
        classes = steps.write(classes.select(F.monotonically_increasing_id().alias("id"), "least", "n", "v"), "classes")
        found = steps.write(range_join(classes.select("id", "n", "v"), cosine, steps), "links")
        linked = found.groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), steps=steps)
        named = classes.select("id", "least").join(joined, "id").groupBy("component").agg(F.min("least").alias("component_id"))
        out = classes.join(linked, "id", "left").join(joined.join(named, "component").select("id", "component_id"), "id", "left")
        out = out.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
        out = steps.keep(steps.write(out, "named"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = good.join(out, "v").select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
