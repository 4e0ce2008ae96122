"""Invariants of the layer, hand-computed metrics, and the clock."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur import harness
from larkspur.functions import sql, words
from larkspur.functions.places import medians, rank_threshold
from larkspur.operators import api, evaluation, search, serving
from larkspur.operators.features import RELATIONS, Layer, refreshed, stored
from larkspur.plans import registry
from larkspur.sources.files import Snapshots, read_csv, write_csv, write_report
from larkspur.sources.retail import Retail

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layer(spark):
    return stored(registry.behaviour(spark, SF))


def test_shelves_hold_unowned_active_products(layer):
    rows = serving.recommend(layer, layer.retail.users).cache()
    assert rows.groupBy("user_id", "product_id").count().where("count > 1").isEmpty()
    assert rows.join(serving.purchased(layer, layer.retail.users), ["user_id", "product_id"], "left_semi").isEmpty()
    assert rows.join(layer.retail.products.where("not is_active"), "product_id", "left_semi").isEmpty()
    assert rows.where("recommendation_rank > 10 or length(recommendation_reason) <= 10").isEmpty()
    rows.unpersist()


def test_an_unknown_user_is_served_trending(layer, spark):
    rows = serving.recommend(layer, spark.createDataFrame([(10**9,)], "user_id long")).collect()
    assert len(rows) == 10 and {r["strategy"] for r in rows} == {"trending"}


def test_nothing_after_the_clock_is_read(layer):
    at = datetime(2024, 1, 10)
    early = Layer(layer.retail, layer.context.with_as_of(at))
    assert early.user_product_features.where(F.col("last_interaction") >= F.lit(at)).isEmpty()


def test_metrics_by_hand(spark):
    served = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "user_id long, product_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "user_id long, product_id long")
    users = spark.createDataFrame([(1, "warm"), (2, "cold")], "user_id long, user_tier string")
    one, two = evaluation.metrics(served, truth, users, 5).orderBy("user_id").collect()
    assert one["precision"] == pytest.approx(0.2) and one["recall"] == 0.5 and one["hit_rate"] == 1
    assert one["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (two["precision"], two["recall"], two["served"]) == (0, 0, 0)


def test_unknown_strategy(layer):
    with pytest.raises(ValueError):
        evaluation.strategy_recommendations(layer, "random", layer.retail.users)


def test_query_syntax():
    assert search.parse('small bolt or "red widget" -hot') == ([[["small"], ["bolt"]], [["red", "widget"]]], [["hot"]])
    assert search.parse('small bolts OR "the running widgets" -hopping') == ([[["small"], ["bolt"]], [["run", "widget"]]], [["hop"]])
    assert search.parse("the of") == ([], [])


def test_stems(spark):
    known = (
        "caresses:caress ponies:poni ties:tie cats:cat gas:gas this:this agreed:agre feed:feed plastered:plaster bled:bled motoring:motor sing:sing "
        "troubled:troubl sized:size hopping:hop hoping:hope falling:fall filing:file happy:happi say:say by:by relational:relat conditional:condit "
        "rational:ration digitizer:digit consistency:consist adoption:adopt knightly:knight formalize:formal hopeful:hope goodness:good revival:reviv "
        "allowance:allow adjustment:adjust replacement:replac probate:probat rate:rate cease:ceas controlling:control roll:roll effective:effect"
    )
    pairs = [p.split(":") for p in known.split()]
    rows = spark.createDataFrame(pairs, "word string, stem string").withColumn("got", words.stem(F.col("word"))).collect()
    assert [(r["word"], r["got"]) for r in rows if r["got"] != r["stem"]] == []
    assert [w for w, s in pairs if words.stem_of(w) != s] == []
    text = "The Small bolts, and RED widgets: running! size_1"
    assert spark.range(1).select(words.stems(F.lit(text)).alias("s")).first()["s"] == words.stems_of(text) == ["small", "bolt", "red", "widget", "run", "size", "1"]
    assert spark.range(1).select(words.stems(F.lit("")).alias("s")).first()["s"] == []


def test_words_side_by_side_rank_higher(layer):
    near = {r["product_id"]: r for r in search.matches(layer, "small bolt", 100).collect()}
    far = {r["product_id"]: r for r in search.matches(layer, "bolts small", 100).collect()}
    assert set(near) == set(far)  # the order of the words decides only the rank
    beside = {i for i, r in near.items() if "small bolt" in r["name"]}
    assert beside and all(near[i]["rank"] > far[i]["rank"] for i in beside)
    assert all(near[i]["rank"] == far[i]["rank"] for i in set(near) - beside)


def test_missing_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_clock_is_a_second_after_the_last_event(spark):
    retail = Retail(spark, SF)
    last = retail.interactions.agg(F.max("interaction_timestamp")).first()[0]
    assert retail.behaviour_clock().as_of == last + timedelta(seconds=1)


def test_refresh_replaces_versions_without_disturbing_readers(spark, tmp_path):
    root = f"file://{tmp_path}"
    shelf = Snapshots(spark, root)
    assert shelf.version("t") is None
    old = shelf.refresh("t", lambda: spark.range(3).withColumnRenamed("id", "x"), "x")
    shelf.refresh("t", lambda: spark.range(5).withColumnRenamed("id", "x"), "x")
    assert (old.count(), Snapshots(spark, root).read("t").count()) == (3, 5) and shelf.bytes("t") > 0
    shelf.clean("t")
    assert shelf.read("t").count() == 5 and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1


def test_a_refreshed_layer_serves_what_the_plan_does(spark, layer, tmp_path):
    plain = registry.behaviour(spark, SF)
    made, report = refreshed(plain, Snapshots(spark, f"file://{tmp_path}"))
    assert [name for name, *_ in report] == list(RELATIONS) and all(rows == getattr(plain, name).count() for name, rows, _ in report)
    rows = lambda x: sorted(map(str, serving.trending(x, 50).collect()))
    assert rows(made) == rows(plain) == rows(layer)


def test_users_without_interactions_share_shelves_but_not_what_they_own(layer):
    users = layer.retail.users
    rows = {}
    for r in serving.recommend(layer, users).collect():
        rows.setdefault(r["user_id"], []).append((r["recommendation_rank"], r["product_id"], r["recommendation_score"]))
    assert all([k for k, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in rows.values()) and len(rows) == users.count()
    some = sorted(rows)[:: max(1, len(rows) // 3)]
    for user in some:  # alone, a user gets what the batch gives
        alone = serving.recommend(layer, users.where(F.col("user_id") == user)).collect()
        assert sorted((r["recommendation_rank"], r["product_id"], r["recommendation_score"]) for r in alone) == sorted(rows[user])
    assert len({tuple(p for _, p, _ in sorted(v)) for v in rows.values()}) > 1


def test_order_statistics_match_sorting(spark):
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 37), (4, 200)) for v in [(i * 7919) % 5000 // 3 * 3 for i in range(n)]]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in medians(df, "g", "v").collect():
        mine = sorted(v for g, v in rows if g == r["g"])
        assert r["median"] == (mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2
    values = sorted(v for _, v in rows)
    for share in (0.0, 0.5, 0.9, 0.999, 1.0):
        ranks = {v: sum(w < v for w in values) / (len(values) - 1) for v in values}
        fit = [v for v in values if ranks[v] >= share]
        assert rank_threshold(df, "v", share).first()["least"] == (min(fit) if fit else None)


def test_cutoff_is_the_discrete_percentile(spark):
    retail = Retail(spark, SF)
    times = sorted(r[0] for r in retail.interactions.select("interaction_timestamp").collect())
    assert evaluation.cutoff_time(retail) == times[max(0, math.ceil(0.8 * len(times)) - 1)]


def test_similar_products_are_ordered_and_fall_back_to_content(layer):
    rows = search.similar(layer, 10).collect()
    basis = {}
    for r in rows:
        assert r["source_product_id"] != r["product_id"]
        basis.setdefault(r["source_product_id"], []).append((r["similarity_basis"], r["similarity_score"]))
    assert {b for v in basis.values() for b, _ in v} == {"collaborative", "content"}
    assert all(len({b for b, _ in v}) == 1 and len(v) <= 10 for v in basis.values())


def test_search_finds_a_product_by_its_name(layer):
    one = layer.retail.products.where("is_active").orderBy("product_id").first()
    assert one["product_id"] in {r["product_id"] for r in search.search(layer, f'"{one["name"]}"', 100).collect()}


def test_trending_obeys_its_limit_and_order(layer):
    for n in (1, 5, 25):
        scores = [r["trending_score"] for r in serving.trending(layer, n).collect()]
        assert len(scores) == n and scores == sorted(scores, reverse=True)


def test_requests_tell_bad_input(layer, tmp_path):
    assert {r["user_tier"] for r in api.recommendations(layer, -5).collect()} == {"unknown"}
    with pytest.raises(KeyError):
        api.similar_products(layer, -5)
    for bad in (lambda: api.search_products(layer, "x"), lambda: api.search_products(layer, "bolt", 0), lambda: api.recommendations(layer, 1, 101)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        api.evaluation(str(tmp_path / "none.json"))
    write_report({"k": 10}, str(tmp_path / "report.json"))
    assert api.evaluation(str(tmp_path / "report.json")) == {"k": 10}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "k int, v string")
    for _ in range(2):
        write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "t"), "k int, v string").collect())) == [(1, "a, b"), (2, None)]


def test_the_layer_answers_sql(spark, layer):
    names = sql.install(layer)
    assert {"rec_decay", "get_trending_products", "product_similarity"} <= set(names)
    assert spark.sql("SELECT rec_as_of()").first()[0] == layer.context.as_of
    row = spark.sql("SELECT rec_setting('weight_similarity'), rec_weight('cart'), rec_decay(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-31', 30D), rec_decay(TIMESTAMP_NTZ '2024-02-01', TIMESTAMP_NTZ '2024-01-31', 30D)").first()
    assert tuple(row) == (0.5, 5, 0.5, 1.0)
    rows = spark.sql("SELECT * FROM get_trending_products(5) ORDER BY trending_score DESC, product_id").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in serving.trending(layer, 5).collect()]
    product = layer.product_similarity.first()["product_a"]
    want = sorted(r["product_b"] for r in layer.product_similarity.where(F.col("product_a") == product).orderBy(F.desc("similarity_score"), "product_b").limit(3).collect())
    assert sorted(r["product_id"] for r in spark.sql(f"SELECT * FROM get_neighbours({product}, 3)").collect()) == want
    assert spark.sql("SELECT * FROM get_preferences(1, 2)").count() <= 2


def test_build_and_benchmark_reports(spark, layer, tmp_path):
    shelf = Snapshots(spark, f"file://{tmp_path}/layer")
    made, report = harness.build(registry.behaviour(spark, SF), shelf)
    assert [r["layer"] for r in report["layers"]] == list(RELATIONS) and all(r["bytes"] > 0 for r in report["layers"])
    times = harness.benchmark({"trending": lambda: serving.trending(made)}, shelf, runs=2)
    harness.save(times, f"{tmp_path}/bench.json")
    assert api.evaluation(f"{tmp_path}/bench.json")["queries"]["trending"]["runs"] == 2
    text = (tmp_path / "bench.md").read_text()
    assert "| trending |" in text and "FileScan parquet" in text
    empty = Layer(Retail(spark, f"{tmp_path}/none"), layer.context)
    for name in ("events", "orders", "lineitem", "customer", "nation", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    with pytest.raises(ValueError):
        harness.build(empty, shelf)
