"""Every query by name, as (spark, sf_dir) -> DataFrame, and the SQL to compare with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.context import Context
from larkspur.operators import evaluation, reads, search, serving
from larkspur.operators.features import Layer, refreshed, stored
from larkspur.plans import oracle
from larkspur.plans.analytics import ANALYTICS
from larkspur.sources.files import Snapshots, fingerprint, shared_dir
from larkspur.sources.retail import Retail

Query = Callable[[SparkSession, str], DataFrame]


_TIMES: dict[tuple, Context] = {}


def _clock(retail: Retail, table: str, find: Callable[[], Context]) -> Context:
    """The clock of a table's files, found once a session for each state of them."""
    key = find.__qualname__, retail.path, fingerprint(retail.spark, [f"{retail.path}/{table}.parquet"])
    if key not in _TIMES:
        _TIMES[key] = find()
    return _TIMES[key]


def behaviour(spark: SparkSession, sf_dir: str) -> Layer:
    retail = Retail(spark, sf_dir)
    return Layer(retail, _clock(retail, "events", retail.behaviour_clock))


def ledger(spark: SparkSession, sf_dir: str) -> Layer:
    retail = Retail(spark, sf_dir)
    return Layer(retail, _clock(retail, "orders", retail.ledger_clock))


def replay(spark: SparkSession, sf_dir: str) -> Layer:
    """The layer at the evaluation cutoff."""
    retail = Retail(spark, sf_dir)

    def at_cutoff() -> Context:
        return retail.behaviour_clock().with_as_of(evaluation.cutoff_time(retail))

    return Layer(retail, _clock(retail, "events", at_cutoff))


#: A name with "stored" reads the written layer; without, each relation is built anew.
_CLOCKS = {
    "behaviour": behaviour,
    "ledger": ledger,
    "replay": replay,
    "stored": lambda spark, sf_dir: stored(behaviour(spark, sf_dir)),
    "stored replay": lambda spark, sf_dir: stored(replay(spark, sf_dir)),
}


def layer_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, rows_loaded: a refresh of all relations of the layer."""
    snapshots = Snapshots(spark, f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}")
    report = refreshed(behaviour(spark, sf_dir), snapshots)[1]
    return spark.createDataFrame([row[:2] for row in report], "layer string, rows_loaded long")


def _query(make: Callable[[Layer], DataFrame], clock: str) -> Query:
    return lambda spark, sf_dir: make(_CLOCKS[clock](spark, sf_dir))


def queries() -> dict[str, Query]:
    found: dict[str, tuple[Callable[[Layer], DataFrame], str]] = {name: (f, clock) for name, f, clock in ANALYTICS}
    for name in ("user_product_features", "user_category_preferences", "product_popularity", "product_trend", "product_similarity"):
        found[name] = (lambda layer, n=name: getattr(layer, n), "behaviour")
    found["user_recommendation_profile"] = (lambda layer: layer.user_profile, "behaviour")
    found["trending_products"] = (serving.trending, "stored")
    found["recommendations"] = (lambda layer: serving.recommend(layer, layer.retail.users), "stored")
    found["similar_products"] = (search.similar, "stored")
    found["similar_products_content"] = (search.similar_by_content, "stored")
    found["search_products"] = (lambda layer: search.search(layer, search.SAMPLE_QUERY), "stored")
    found["eval_ground_truth"] = (evaluation.ground_truth, "replay")
    found["eval_candidate_users"] = (evaluation.candidate_users, "stored replay")
    found["eval_split_stats"] = (evaluation.split_stats, "replay")
    found["eval_sample_users"] = (lambda layer: evaluation.sample_users(layer, 100).select("user_id"), "stored replay")
    for strategy in ("popularity", "collaborative"):
        name = {"popularity": "popularity_baseline", "collaborative": "cf_baseline"}[strategy]
        found[name] = (lambda layer, s=strategy: evaluation.strategy_recommendations(layer, s, evaluation.candidate_users(layer)), "stored replay")
    for strategy in evaluation.STRATEGIES:
        found[f"coverage_report_{strategy}"] = (lambda layer, s=strategy: evaluation.coverage_report(layer, s), "stored replay")
        found[f"metrics_by_tier_{strategy}"] = (lambda layer, s=strategy: evaluation.metrics_by_tier(layer, s), "stored replay")
    found |= {name: (f, clock) for name, f, clock in reads.READS}
    out = {name: _query(f, clock) for name, (f, clock) in found.items()}
    out["evaluation_cutoff"] = lambda spark, sf_dir: evaluation.cutoff(Retail(spark, sf_dir))
    out["run_evaluation"] = lambda spark, sf_dir: evaluation.run_evaluation(Retail(spark, sf_dir))
    out["layer_refresh"] = layer_refresh
    return out


def oracles() -> dict[str, str]:
    return oracle.all_sql()


__all__ = ["behaviour", "ledger", "oracles", "queries", "replay"]
