"""URL filter over a sorted, memory-mapped array of 64-bit digests."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import prepare, shared_dir

#: Verdict of a url that no rule fits.
DEFAULT = "allow"


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    after = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@dataclass(frozen=True)
class Shapes:
    """(labels of the host, characters of the path) that occur among the rules: what to probe."""

    pairs: tuple[tuple[int, int], ...]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def build(rules: dict[str, str]) -> tuple[bytes, Shapes]:
    """The index of rules (``host/path`` -> verdict).

    Layout: count, then sorted 64-bit digests, then the offsets of the full
    strings, then the strings, each with its verdict after a NUL. Equal digests
    stand side by side.
    """
    for rule in rules:
        if "\0" in rule or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r}")
    keyed = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in rules.items())
    texts = [f"{r}\0{v}".encode() for _, r, v in keyed]
    offsets = np.cumsum([0, *map(len, texts)]).astype("<u8")
    digests = np.array([d for d, _, _ in keyed], dtype="<u8")
    shapes = {(r.partition("/")[0].count(".") + 1, len(split_rule(r)[1])) for r in rules}
    return struct.pack("<Q", len(keyed)) + digests.tobytes() + offsets.tobytes() + b"".join(texts), Shapes(tuple(sorted(shapes)))


class Index:
    """The digest array, mapped from its file; pages are shared by all workers of a machine."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.texts = raw[16 + 16 * n :]

    def verdicts(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key that is a rule: one binary search for all, then the stored string decides."""
        out: list[str | None] = [None] * len(keys)
        if not keys or not len(self.digests):
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, wanted)
        for i in np.nonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)[0]:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                rule, _, verdict = bytes(self.texts[int(self.offsets[k]) : int(self.offsets[k + 1])]).decode().partition("\0")
                if rule == keys[i]:
                    out[i] = verdict
                    break
                k += 1
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> Index:
    return Index(SparkFiles.get(name))


def publish(spark: SparkSession, index: bytes) -> str:
    """Write the index to the shared folder and let Spark hand it to every executor, later ones included."""
    name = f"urls-{hashlib.sha256(index).hexdigest()[:24]}.bin"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        stream = files.create(place, True)
        stream.write(bytearray(index))
        stream.close()
    spark.sparkContext.addFile(path)
    return name


def probes(host: str, path: str, shapes: Shapes) -> list[str]:
    """The rules of the known shapes that fit: host suffix at a label, then path prefix."""
    labels = host.split(".")
    return [".".join(labels[len(labels) - n :]) + path[:m] for n, m in shapes.pairs if n <= len(labels) and m <= len(path)]


def judge(pages: DataFrame, rules: dict[str, str], default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, a row a row.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins; without one, rule is null and the verdict is
    ``default``. Null urls and urls without ``://`` have an empty host and path,
    which no rule fits. Other columns are not read, repeated rows stay, an empty
    table or an empty list of rules is no special case.

    A list that the driver holds as a dictionary goes to the executors as a file;
    a list that is a table goes by :func:`judge_by_join`.
    """
    spark = prepare(pages.sparkSession)
    index, shapes = build(rules)
    name = publish(spark, index)
    host, path = host_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _opened(name)
        for batch in batches:
            tried = [probes(h, p, shapes) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            verdicts = iter(found.verdicts([k for keys in tried for k in keys]))
            best = [max(((len(k), k, v) for k in keys if (v := next(verdicts)) is not None), default=(0, None, default)) for keys in tried]
            rule, verdict = pa.array([b[1] for b in best], pa.string()), pa.array([b[2] for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same for a table (rule, verdict) of any size, by joins.

    A page's host suffixes find the lengths of the paths that rules of that host
    have (a row a host, so a hot host's pages can be split), and host with a path
    prefix of such a length finds the rule. Rows with a null rule or verdict, or
    without a slash, are no rules; of a rule that repeats the least verdict holds.
    """
    prepare(pages.sparkSession)
    host, path = host_path()
    at = F.locate("/", "rule")
    known = rules.where("verdict is not null").withColumn("at", at).where("at > 0").groupBy("rule", "at").agg(F.min("verdict").alias("verdict"))
    by_host = known.groupBy(F.substr("rule", F.lit(1), F.col("at") - 1).alias("suffix")).agg(F.collect_set(F.length("rule") - F.col("at") + 1).alias("lengths"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    met = rows.withColumn("suffix", F.explode(suffixes)).join(by_host, "suffix")
    fitting = F.filter("lengths", lambda k: k <= F.length("path"))
    tried = met.withColumn("k", F.explode(fitting)).withColumn("rule", F.concat("suffix", F.substr("path", F.lit(1), F.col("k"))))
    best = tried.join(known, "rule").groupBy("row").agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("b"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
