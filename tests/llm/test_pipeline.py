"""The stages of the corpus pipeline on a small input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import common, encoding, langid, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_reject(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.selectExpr("*", "'x' AS score", "1 AS n").unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "'12 34' AS text", "lang", "source", "n_chars", "'x' AS score", "1 AS n"))
    kept = corpus_pipeline.language_id(spark, extra, SF)
    assert kept.columns == extra.columns and kept.count() == docs.count()
    good = corpus_pipeline.quality_filter(spark, kept, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.columns == extra.columns
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * kept.join(labels.where("quality = 1"), "doc_id").count()
    once = corpus_pipeline.near_duplicates(spark, good, SF)
    want = {r["component_id"] for r in neardup.near_duplicates(good).collect()}
    assert {r["doc_id"] for r in once.collect()} == want
    assert corpus_pipeline.pack(spark, corpus_pipeline.mix_sources(spark, once, SF), SF).count() > 0


def test_language_rejects_what_resembles_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = ["αβγδε ζηθικ λμνξο πρστυ " * 20, "qzx vkjq xwz jjkq zzxv wqkx " * 20, "日本語のテキスト" * 20]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    given = docs.unionByName(rows, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, given, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_language_stage_learns_from_all_documents(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) if rnd.random() < i / 12_000 else "".join(rnd.choice("jklmnopqrs") for _ in range(4)) for _ in range(6)) for i in range(12_000)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    seen, floor_of = [], corpus_pipeline.language_floor
    monkeypatch.setattr(corpus_pipeline, "language_floor", lambda d, p: seen.append((p, floor_of(d, p))) or seen[-1][1])
    monkeypatch.setattr(langid, "HELD", 3000, raising=False)
    kept = corpus_pipeline.language_id(spark, docs, SF).count()
    [(profiles, floor)] = seen
    codes, times = (np.concatenate(a) for a in zip(*map(langid.ngrams, texts), strict=True))
    codes, at = np.unique(codes, return_inverse=True)
    want = langid.profiles_of({"xx": (codes, np.bincount(at, times).astype(np.int64))})
    assert np.array_equal(profiles.codes, want.codes) and np.array_equal(profiles.ranks, want.ranks)
    scores = np.array([want.predict(t)[1] for t in texts])
    assert floor == 0.5 * np.quantile(scores, 0.01) and kept == (scores >= floor).sum()


@pytest.mark.parametrize("ranges", [16, 1024])
def test_quantiles_are_exact(spark, monkeypatch, ranges):
    monkeypatch.setattr(common, "RANGES", ranges)
    rnd = np.random.default_rng(2)
    near = 0.25 + np.spacing(0.25) * np.arange(9)
    for values in ([0.5], [0.0, 1.0], np.round(rnd.random(500), 2), np.concatenate([rnd.random(300) ** 9, near, near])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double")
        for share in (0.01, 0.37, 1.0):
            assert common.quantile(rows, "score", share) == np.quantile(values, share), (len(values), share)
    assert common.quantile(rows.where("score is null"), "score", 0.01) is None


def test_quality_threshold_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit("split"), "doc_id"), F.lit(2))
    passed, lost, held = 0, 0, {0: 0, 1: 0}
    for k in (0, 1):
        model = quality.train(docs, labels.where(half == k))
        for r in docs.join(labels.where(half != k), "doc_id").select("quality", quality.score_column(model)().alias("score")).collect():
            held[r["quality"]] += 1
            passed += r["quality"] == 0 and r["score"] >= corpus_pipeline.REJECT_BELOW
            lost += r["quality"] == 1 and r["score"] < corpus_pipeline.REJECT_BELOW
    assert passed <= 0.01 * held[0] and lost <= 0.01 * held[1]


def plain_mix(rows):
    """(doc_id, text) taken of (doc_id, text, source), in plain Python."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    by_need = sorted(sizes, key=lambda s: (2 * sizes[s] / weight[s], s))
    total = 1.5 * sum(sizes.values())
    level = max((total - sum(2 * sizes[s] for s in by_need[:i])) / sum(weight[s] for s in by_need[i:]) for i in range(len(by_need)))
    out = []
    for s in sizes:
        left = int(min(weight[s] * level, 2 * sizes[s]) + 0.5)
        mine = sorted((hashlib.md5(str(k).encode()).hexdigest(), k, t) for k, t, x in rows if x == s)
        for _, k, t in mine * 2:
            words = t.split()
            take = min(left, len(words))
            left -= take
            out += [(k, t if take == len(words) else " ".join(words[:take]))] if take else []
    return out


def test_run_matches_plain_python(spark, tmp_path):
    rnd = random.Random(4)
    vocabulary = {"en": ["the", "and", "house", "with", "thing", "water", "light", "stone"], "de": ["der", "und", "haus", "mit", "nicht", "wasser", "licht", "stein"]}
    rows = []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        base = [rnd.choice(vocabulary[lang]) + rnd.choice(vocabulary[lang]) for _ in range(rnd.choice([30, 300, 700]))]
        near = list(base)
        for _ in range(len(base) // (100 if i % 4 else 25)):  # some near copies, some too far
            near[rnd.randrange(len(near))] = "x"
        rows += [(2 * i, " ".join(base), lang, "abc"[i % 3]), (2 * i + 1, " ".join(near), lang, "abc"[(i + 1) % 3])]
    rows += [(200 + i, f"{i} {i + 1} !!", "en", "a") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200)) for k, *_ in rows], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs, labels = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "labels"))
    profiles = langid.train(docs)
    said = {k: profiles.predict(t) for k, t, *_ in rows}
    floor = 0.5 * np.quantile([score for lang, score in said.values() if lang != "und"], 0.01)
    left = [r for r in rows if said[r[0]][0] != "und" and said[r[0]][1] >= floor]
    model = quality.train(docs.where(F.col("doc_id").isin([r[0] for r in left])), labels)
    left = [r for r in left if model.score(np.array([quality.statistics(r[1])]))[0] >= 0.3]
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, t, *_ in left for w in [t.split()]}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    once = [(k, t, source) for k, t, _, source in left if label[k] == k]
    assert 40 < len(once) < 80 == len(left)
    library = encoding.load(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, text in plain_mix(once):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((k, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes())) for at in range(0, len(ids), 1024))
    assert got == want
