"""What several operators of this package share: session set-up, shared storage,
byte-bounded Arrow batches and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so batches are kept short.
ARROW_ROWS = 512
ARROW_BYTES = 2 << 20
# Python workers outlive their stage, so what they free goes back to
# the machine at once (glibc keeps arrays of up to 32 MB otherwise, Arrow its pool).
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of texts that are encoded together, so that more of their words are the same.
ENCODE_BYTES = 2 << 20
#: Bits of the filter that spares rows a shuffle: a broadcast of at most
#: ``SLOTS`` / 64 rows whatever the input.
SLOTS = 1 << 26
#: Ranges that ``quantile`` counts by in a pass; so many rows come to the driver.
RANGES = 1024
#: Bytes that a task holds of a Parquet file it writes to shared storage.
ROW_GROUP_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Python workers import this package.

    On a cluster the package is shipped with ``--py-files``; the path set here
    only matters where workers share the driver's file system.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all run on one machine (tests) a temporary folder
    is made; on a cluster that would lose rows, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage in a form that outlives any executor, and computes the
    input once where ``checkpoint()`` would compute it twice.
    """
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def by_bytes(values: Iterable, limit: int, size: Callable = len) -> Iterator[list]:
    """Cut values into runs whose sizes sum to about ``limit``."""
    run: list = []
    total = 0
    for value in values:
        run.append(value)
        total += size(value)
        if total >= limit:
            yield run
            run, total = [], 0
    if run:
        yield run


def joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about ``limit`` bytes."""
    for run in by_bytes(batches, limit, size=lambda b: b.nbytes):
        if whole := pa.Table.from_batches(run).combine_chunks().to_batches():
            yield whole[0]


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Steps:
    """Tables written on the way to a result, and deleted when nothing needs them.

    As a context manager it deletes at the end what was not kept. Whoever reads
    a table must keep it, or write what was read, before it goes.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        self.delete(*(df for df, _ in list(self.held.values())))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _stored(df, name)
        self.held[id(out)] = out, path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave a table in the shared folder, for a result that reads it later."""
        self.held.pop(id(df), None)
        return df

    def delete(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.held.pop(id(df), (df, ""))
            if path:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def perhaps(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` and maybe, false only where the columns ``names`` are not among ``keys``.

    A bitmap of ``SLOTS`` bits is broadcast, so its size does not grow with the
    input; where it fills up, more rows are maybe. What is not maybe needs no shuffle.
    """
    slot = F.pmod(F.xxhash64(*names), F.lit(SLOTS))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, bit)")
    bits = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))
    probe = rows.withColumn("word", word).withColumn("bit", bit)
    hit = F.expr("shiftright(bits, bit) & 1") == 1
    return probe.join(F.broadcast(bits), "word", "left").withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("word", "bit", "bits")


def quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile of all finite doubles of a column, as numpy's default has it; None without any.

    A pass counts the values by ``RANGES`` equal ranges and the next one looks
    into the range that holds the place, until that is a single value, so
    neither a task nor the driver holds more than the ranges. Reads ``rows`` a
    few times: write them first if they cost much.
    """
    x = F.col(value)
    low, high, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return None
    at = (n - 1) * share
    place, before = int(at), 0
    while low < high:
        part = F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(RANGES)))
        counted = rows.where(x.between(low, high)).groupBy(part).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))
        for r in sorted(counted.collect(), key=lambda r: r["low"]):
            if before + r["n"] > place:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    until, above = rows.agg(F.count(F.when(x <= low, x)), F.min(F.when(x > low, x))).first()
    return float(np.quantile([low, low if until > place + 1 or above is None else above], at - place))


def components(edges: DataFrame, a: str = "a", b: str = "b", steps: Steps | None = None) -> DataFrame:
    """Connected components of an undirected graph of long ids.

    Returns (id, component) for each id in an edge, component being the
    smallest id reachable. Each round points every label at the smallest label
    next to it, follows pointers twice and contracts the edges; at least half
    of the labels vanish in a round, so rounds grow with the logarithm of the
    graph. No edge or label reaches the driver: it only asks whether edges are
    left. Joins on a hot label are left to adaptive skew splitting. What a round
    supersedes is deleted; the result is a table of ``steps``.
    """
    steps = steps or Steps(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    left = steps.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    labels = nodes.select("id", F.col("id").alias("component"))
    while not left.isEmpty():
        either = left.union(left.select("b", "a"))
        up = either.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        near = far = steps.write(up, "pointers")
        for _ in range(2):
            far = far.alias("x").join(far.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", F.col("y.b").alias("b"))
        far = steps.write(far, "pointers")
        steps.delete(near)
        before = labels
        labels = labels.join(far, labels.component == far.a, "left").select("id", F.coalesce("b", "component").alias("component"))
        labels = steps.write(labels, "labels")
        p, q = far.select(F.col("a").alias("pa"), F.col("b").alias("pb")), far.select(F.col("a").alias("qa"), F.col("b").alias("qb"))
        moved = left.join(p, left.a == p.pa).join(q, left.b == q.qa).select(F.least("pb", "qb").alias("a"), F.greatest("pb", "qb").alias("b"))
        after = steps.write(moved.where("a <> b").distinct(), "edges")
        steps.delete(before, far, left)
        left = after
    return labels
