"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time t in 0..1,
``w(t) = w * (1 + s * (2t - 1))``, whose integral is its weight ``w``. The share
of the source's demand that is met by time t is the integral ``t + s(t^2 - t)``.
A source's documents stand in the order of a hash; the demand that is met
before a document is the number of the source's words before it. Inverting the
integral at that demand gives the document's time, its training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import stored

# The mix of the contract.
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, -0.5, 0.0)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order hash that number a source's parts: 4096 of them, so
#: that running sums never need a whole source in one task.
PART_DIGITS = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycle(values: tuple, index: Column) -> Column:
    """The values in turn, by a 0-based index."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A source's words, target and slope, from (source, source_size), a row a source.

    Sources in code point order, null last, take the weights in turn. Targets
    are min(w * level, cap), where the level makes them sum to ``share`` of all
    words; with caps in ascending order of cap / weight it is the greatest of
    (total - caps before) / (weights from here), because the sum is concave in
    the level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    rows = rows.select("source", "source_size", cycle(weights, F.col("k")).alias("w"), cycle(slopes, F.col("k")).alias("slope"), (F.col("source_size") * float(repeats)).alias("cap"))
    by_need = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double") * share
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("w").over(by_need.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("line", (total - before) / later)
    rows = rows.withColumn("level", F.max("line").over(everything))
    return rows.select("source", "source_size", "slope", F.least(F.col("w") * F.col("level"), F.col("cap")).alias("target"))


def time_of(share: Column, slope: Column) -> Column:
    """The t in 0..1 at which ``t + s(t^2 - t)`` is the given share."""
    b = 1.0 - slope
    root = (F.sqrt(b * b + 4.0 * slope * share) - b) / (2.0 * slope)
    return F.when(slope == 0.0, share).otherwise(root)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """What the mix takes of every document, in training order.

    doc_id, size, source_size, target, taken, position, again: ``taken`` words
    in all (whole passes over the source, the last one cut where the target is
    met, in the middle of a document if need be), ``position`` and ``again``
    the times of its first and second taking (null where not taken), rounded to
    9 places. Rows are sorted by position, untaken ones last.

    The order within a source is by md5(doc_id), doc_id, size, so reruns agree
    and equal rows are interchangeable. A null text has size 0; a null source is
    a source of its own, the last; a null doc_id is ordered as an empty one; an
    empty table gives an empty result; a source without words has target 0.
    """
    sized = stored(_sized(docs), "sizes")
    out = _taken(sized, sized, ["doc_id"], ["size"], weights, slopes, share, repeats)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _sized(docs: DataFrame, *extra: Column, text: str = "text") -> DataFrame:
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), hashed.alias("h"), *extra)
    return sized.withColumn("part", F.substring("h", 1, PART_DIGITS))


def _source_keys(source: str) -> list[Column]:
    return [F.coalesce(F.col(source), F.lit("")).alias("k0"), F.col(source).isNull().alias("k1")]


def _taken(sized: DataFrame, measured: DataFrame, columns: list, last: list, weights: tuple, slopes: tuple, share: float, repeats: int) -> DataFrame:
    """``columns`` of ``sized``, size, source_size, target, taken, position, again; unsorted.

    Sizes of parts and sources are summed over ``measured``; ``last`` orders rows
    of one doc_id.
    """
    parts = measured.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), weights, slopes, share, repeats)
    ahead = F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("part_size")
    starts = parts.select("source", "part", ahead.alias("start")).alias("p")
    keys = _source_keys("p.source")  # without nulls, so that the rows are dealt once for window and join
    starts = starts.join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(*keys, "part", "start", "source_size", "slope", "target")
    order = W.partitionBy("k0", "k1", "part").orderBy("h", "doc_id", *last).rowsBetween(W.unboundedPreceding, 0)
    keyed = sized.select("*", *_source_keys("source"))
    run = keyed.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    both = run.alias("r").join(starts.alias("s"), (F.col("r.k0") == F.col("s.k0")) & (F.col("r.k1") == F.col("s.k1")) & (F.col("r.part") == F.col("s.part")))
    at = F.col("start") + F.col("inside")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    rows = both.select(*columns, "size", "source_size", "target", "slope", at.alias("at"), quota.alias("quota"))

    def of_pass(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("source_size") * k - F.col("at"))).cast("long")

    def position(k: int) -> Column:
        share_met = F.try_divide((F.col("source_size") * k + F.col("at")).cast("double"), F.col("target"))
        return F.when(of_pass(k) > 0, F.round(F.abs(time_of(share_met, F.col("slope"))), 9))

    taken = sum((of_pass(k) for k in range(1, repeats)), of_pass(0))
    return rows.select(*columns, "size", "source_size", "target", taken.alias("taken"), position(0).alias("position"), position(1).alias("again"))


def apply(docs: DataFrame, text: str = "text", weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mixed rows of ``docs``, with all their columns, in training order.

    A document stands once for each pass that takes it; the pass that the target
    cuts keeps the words taken, joined by blanks. Rows that the mix takes no word
    of are left out; rows that share a doc_id are mixed each on its own.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sized = _sized(docs, row, F.xxhash64(text).alias("mark"), text=text)
    measured = stored(sized.select("source", "part", "size"), "sizes")
    plan = _taken(sized, measured, ["doc_id", "row"], ["size", "mark"], weights, slopes, share, repeats).where("taken > 0")
    passes = F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))
    spread = plan.withColumn("pass", F.explode(passes))
    kept = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    at = F.when(F.col("pass") == 0, F.coalesce("position", "again")).otherwise(F.coalesce("again", "position"))
    ordered = spread.select("doc_id", at.alias("at"), "size", kept.alias("kept"), "row").orderBy("at", "doc_id")
    whole = F.col(f"row.`{text}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"({WORD})")), F.lit(1), F.col("kept").cast("int")), " ")
    mixed = F.when(F.col("kept") < F.col("size"), cut).otherwise(whole).alias(text)
    return ordered.select(*(mixed if c == text else F.col(f"row.`{c}`") for c in docs.columns))
