"""Building the layer, timing queries, and reports of both."""

from __future__ import annotations

import re
import statistics
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from larkspur.operators.features import RELATIONS, Layer, refreshed
from larkspur.sources.files import Snapshots, row_counts, write_report

#: Timed runs of a query, after one that isn't timed.
RUNS = 5


def build(layer: Layer, snapshots: Snapshots) -> tuple[Layer, dict]:
    """Load checks, refresh of all relations, sizes; the report has what each step took."""
    retail = layer.retail
    start = time.perf_counter()
    loaded = row_counts({"interactions": retail.interactions, "orders": retail.orders, "products": retail.products, "users": retail.users})
    if not loaded["interactions"] or not loaded["products"]:
        raise ValueError(f"nothing to build from: {loaded}")
    made, layers = refreshed(layer, snapshots)
    report = {
        "as_of": layer.context.as_of.isoformat(sep=" "),
        "mode": layer.context.mode,
        "loaded": loaded,
        "layers": [{"layer": name, "rows_loaded": rows, "elapsed_seconds": took, "bytes": snapshots.bytes(name)} for name, rows, took in layers],
        "elapsed_seconds": round(time.perf_counter() - start, 3),
    }
    return made, report


def plan_nodes(df: DataFrame) -> dict[str, int]:
    """How many of each scan, join, exchange and sort the physical plan has."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"(FileScan \w+|\w*Join\b|\w*Exchange\b|\w+Aggregate\b|\bWindow\b|\bSort\b)", plan)
    return dict(sorted(Counter(found).items()))


def timed(make: Callable[[], DataFrame], runs: int = RUNS) -> dict:
    """Median, least and greatest seconds of ``runs`` runs after a warm-up, and the plan's nodes."""
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        df = make()
        df.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return {"median_seconds": round(statistics.median(seconds[1:]), 4), "least": round(min(seconds[1:]), 4), "greatest": round(max(seconds[1:]), 4), "runs": runs, "plan": plan_nodes(df)}


def benchmark(queries: dict[str, Callable[[], DataFrame]], snapshots: Snapshots | None = None, runs: int = RUNS) -> dict:
    report: dict = {"queries": {name: timed(make, runs) for name, make in queries.items()}}
    if snapshots is not None:
        report["bytes"] = {name: snapshots.bytes(name) for name in RELATIONS if snapshots.version(name)}
    return report


def markdown(report: dict) -> str:
    """The benchmark report as a table."""
    lines = ["| Query | Median s | Least | Greatest | Plan |", "| - | - | - | - | - |"]
    for name, row in report["queries"].items():
        plan = ", ".join(f"{n} {node}" for node, n in row["plan"].items())
        lines.append(f"| {name} | {row['median_seconds']} | {row['least']} | {row['greatest']} | {plan} |")
    for name, size in report.get("bytes", {}).items():
        lines.append(f"| {name}: {size} bytes | | | | |")
    return "\n".join(lines) + "\n"


def save(report: dict, path: str) -> None:
    """The report as ``path`` (JSON) and beside it as Markdown."""
    write_report(report, path)
    if "queries" in report:
        with open(re.sub(r"\.json$", "", path) + ".md", "w") as out:
            out.write(markdown(report))
