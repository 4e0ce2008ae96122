"""Column builders shared by all relations; none of them is a Python UDF."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.context import FUNNEL


def rnd(x: Column | str, n: int) -> Column:
    """Round half away from zero through a decimal, the same in any engine."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("decimal(30,10)"), n).cast("double")


def div(a: Column | str, b: Column | str) -> Column:
    """Double division; null where the divisor is 0 or null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column | str, b: Column | str, n: int = 2) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return rnd(div(a.cast("double") * 100.0, b), n)


def weight(kind: str = "interaction_type") -> Column:
    """Funnel weight of an interaction type, 0 for any other."""
    out = F.lit(0)
    for name, (w, _) in FUNNEL.items():
        out = F.when(F.col(kind) == name, F.lit(w)).otherwise(out)
    return out


def moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, as_of: datetime) -> Column:
    return (micros(moment(as_of)) - micros(ts)).cast("double") / 86_400_000_000.0


def decay(ts: Column, as_of: datetime, half_life: float) -> Column:
    """0.5 to the age in half-lives; 1 for the future and for a null time."""
    age = F.greatest(age_days(ts, as_of), F.lit(0.0))
    return F.pow(F.lit(0.5), age / F.lit(float(half_life)))


def is_kind(name: str) -> Column:
    return F.col("interaction_type") == name


def month(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "month")


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def minmax(x: str, window, flat: float = 0.0) -> Column:
    """Min-max over a window; ``flat`` where all values are equal."""
    lo, hi = F.min(x).over(window), F.max(x).over(window)
    return F.coalesce(div(F.col(x) - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(flat))
