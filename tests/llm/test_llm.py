"""The corpus operators against brute force, round trips and odd rows."""

import gzip
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from larkspur.llm import audio, common, encoding, langid, mixing, neardup, packing, quality, queries, tokens, urls, vectors, warc
from larkspur.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, None, "x", "y") for k, t, lang, s in rows], DOCS)


ODD = [(None, "some words here that are fine", "en", None), (1, None, None, "a"), (2, "", "en", "a"), (2, "", "en", "a"), (3, "word " * 30000, "en", "b"), (4, "!!! 123", "de", None)]


def words_of(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choices("abcdefgh", k=4)) for i in range(400)]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoder_gives_the_library_s_ids(name, monkeypatch):
    path = public_tokenizers.path(name)
    library = encoding.load(path)
    rnd = random.Random(1)
    texts = ["", " ", "a  b ", "x\n y", "\u00e9 <|endoftext|> b", "don't 's", "\u65e5\u672c \u8a9e", "a \x1cb c\x85 d", "a" * 3000, "Word, word. WORD!", "\u65e5\u672c\u8a9e\u3002" * 400, "line\n" * 300 + "end ", "one\ntwo'\n's " * 90]
    texts += ["".join(rnd.choice(" abC\n\t\u00e9'1\u00b2_!\u0301\xa0,.<|>\u3002\uff0c\u8a9e") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    texts += ["".join(rnd.choice("ab\n\u00e9'1\u0301\u3002\uff0c\u8a9e\u1161") for _ in range(rnd.randrange(65, 150))) for _ in range(300)]
    if name.endswith(".model"):
        want = library.encode(texts, num_threads=1)
    else:
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (encoding.CACHE_PIECES, 50):
        monkeypatch.setattr(encoding, "CACHE_PIECES", limit)
        full, short = encoding.Encoder(path, True), encoding.Encoder(path, False)
        assert full.safe == (not name.endswith(".model"))
        for part in range(0, len(texts), 100):
            for _ in range(2):
                batch = pa.array(["unseen", *texts[part : part + 100]])[1:]
                ids, at = full.ids(batch, 7)
                for k, text in enumerate(texts[part : part + 100]):
                    assert ids[at[k] : at[k + 1]].tolist() == [*want[part + k], 7], repr(text)
                assert short.counts(batch).tolist() == [len(x) for x in want[part : part + 100]]


def test_an_idle_encoder_forgets(monkeypatch):
    monkeypatch.setattr(encoding, "IDLE", 0.1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for _ in range(2):
        with encoding.encoder(path, False) as made:
            assert made.counts(pa.array(["the house of words"])).tolist() == [4]
        assert len(made.known) == 4
        time.sleep(0.5)
        assert len(made.known) == 0


def test_unknown_tokenizers_get_whole_texts(tmp_path):
    rules = json.loads(encoding.load(public_tokenizers.path("byte_bpe_50k.json")).to_str())
    rules["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": "_"}
    (tmp_path / "other.json").write_text(json.dumps(rules))
    made = encoding.Encoder(str(tmp_path / "other.json"), True)
    texts = ["a b  c", "", "the house of words"]
    ids, at = made.ids(pa.array(texts), 0)
    assert not made.safe and [ids[s : e - 1].tolist() for s, e in zip(at, at[1:])] == [encoding.load(str(tmp_path / "other.json")).encode(t).ids for t in texts]


def test_token_counts_of_odd_rows(spark):
    got = tokens.token_counts(docs(spark, ODD), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(ODD) and [r["over_limit"] for r in got if r["doc_id"] == 3] == [True]
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0, 0]
    assert tokens.token_counts(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).isEmpty()


def test_plan_covers_each_item_once():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 1025, 700))
    ranks = np.arange(len(sizes)) - np.searchsorted(sizes, sizes)
    values, counts = np.unique(sizes, return_counts=True)
    plan = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    sequence, offset = plan.place(sizes, ranks)
    taken = sorted(zip(sequence.tolist(), offset.tolist(), sizes.tolist(), strict=True))
    for (s, o, n), (t, p, _) in zip(taken, taken[1:], strict=False):
        assert p == (o + n if s == t else 0)
    assert max(o + n for _, o, n in taken) <= 1024


def test_pack_keeps_every_id(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = encoding.load(path)
    rows = [(i + 10, words_of(random.Random(i), 40 * i), "en", "a") for i in range(40)] + ODD
    got = packing.pack(docs(spark, rows), path).collect()
    want = Counter()
    for k, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((k, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024))
    assert Counter(tuple(r[:5]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert packing.pack(docs(spark, []), path).isEmpty()


def test_trees_learn_and_survive_odd_input(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    constant = quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0))
    got = quality.classify(docs(spark, ODD), constant).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}


def test_language(spark):
    english, german = "the cat and the dog of the house with that thing", "der hund und die katze mit dem haus nicht schön"
    taught = docs(spark, [(i, english, "en", "a") for i in range(5)] + [(i + 9, german, "de", "a") for i in range(5)])
    profiles = langid.train(taught)
    assert profiles.predict("the dog with the thing")[0] == "en" and profiles.predict("und nicht mit der katze")[0] == "de"
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs(spark, ODD), profiles).collect()}
    assert {(1, "und"), (2, "und"), (4, "und")} <= got
    assert langid.profiles_of({}).predict("abc") == ("und", 0.0)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:200] = x[:100] + 0.25 * rng.normal(size=(100, 8)).astype(np.float32)
    x[250] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0])]
    vectors.CELL, vectors.BLOCK, kept = 40, 16, (vectors.CELL, vectors.BLOCK)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    vectors.CELL, vectors.BLOCK = kept
    u = vectors.unit(x.astype(np.float64))
    near = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    label = np.arange(300)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(300)])
        if (new == label).all():
            break
        label = new
    assert [got[i]["n_links"] for i in range(300)] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(300)] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))


def test_vectors_that_share_an_id_are_apart(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.99, 0.1]), (3, [0.99, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.9])]
    got = sorted(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(30):
        base = words_of(rnd, rnd.choice([3, 30, 150])).split()
        for j in range(5):
            text = list(base)
            for _ in range(j):
                text[rnd.randrange(len(text))] = rnd.choice(VOCABULARY)
            rows.append((10 * i + j, " ".join(text) + (" same closing words in many texts" if i % 2 else ""), "en", "a"))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), words=4).collect()}
    sets = {k: set(neardup.shingles(t, 4).tolist()) for k, t, *_ in rows}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert got == label
    odd = neardup.near_duplicates(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r["kept"] for r in odd)


def components_of(sets, percent=80):
    """Least key that a chain of pairs of Jaccard similarity of ``percent`` reaches, by brute force."""
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def word_shingles(text, words):
    """Shingles by the contract's words, apart from the operator's code."""
    found = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def test_shingles_follow_the_rule_for_words():
    rnd = random.Random(8)
    for _ in range(300):
        text = "".join(rnd.choice("aBÉé\x1c\x85\xa0 \t\n\x0b\x0c\r,K") for _ in range(rnd.randrange(30)))
        assert len(neardup.shingles(text, 4)) == len(word_shingles(text, 4)), repr(text)


@pytest.mark.parametrize("limits", [{}, {"LIST": 1}, {"BLOCK_DOCS": 3}, {"LIST": 3, "BLOCK_BYTES": 4000}])
def test_near_duplicates_match_independent_shingles(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rnd = random.Random(6)
    rows = []
    for i in range(16):
        base = words_of(rnd, rnd.choice([2, 40, 200, 700])).split()
        for j in range(10):
            text = list(base)
            for _ in range(rnd.randrange(1 + len(base) // 12)):
                text[rnd.randrange(len(text))] = rnd.choice(VOCABULARY)
            rows.append((10 * i + j, rnd.choice(["\n", " ", " \t"]).join(text).replace("ab", "AB") + (" a passage that many of the texts share" if i % 3 == 0 else ""), "en", "a"))
    rows += [(900, None, None, None), (901, " \n", None, None), (902, rows[5][1].upper(), None, None)]
    given = docs(spark, rows)
    sets = {k: word_shingles(t, 4) for k, t, *_ in rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(given, words=4).collect()}
    label = components_of(sets)
    assert 10 < len(set(label.values())) < len(label) - 20
    assert got == {k: (len(sets[k]), label[k], label[k] == k) for k in sets}
    dropped = neardup.drop_duplicates(given.withColumn("__mark", given.doc_id).withColumn("row", given.text), words=4)
    assert dropped.columns[-2:] == ["__mark", "row"]
    assert sorted(r["doc_id"] for r in dropped.collect()) == sorted(set(label.values()))


def test_pairs_inside_a_task_match_brute_force():
    """Lists and blocks of every size, and two-sided blocks, as the tasks see them."""
    rng = np.random.default_rng(2)
    for size in (2, 5, 40, 90):
        centres = [rng.integers(0, 1 << 60, 300) for _ in range(3)]
        sets = []
        for k in range(size):
            s = centres[k % 3].copy()
            some = rng.random(300) < rng.choice([0.02, 0.08, 0.15])
            s[some] = rng.integers(0, 1 << 60, some.sum())
            sets.append(np.unique(s[: rng.choice([300, 260])]))
        ids = rng.permutation(1000)[:size]
        near = np.array([[np.intersect1d(a, b).size * 100 >= 80 * np.union1d(a, b).size for a in sets] for b in sets])
        wanted = components_of({int(k): {int(k)} for k in ids})

        def joined(pairs):
            label = {int(k): int(k) for k in ids}
            for a, b in pairs:
                x, y = label[int(a)], label[int(b)]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            return label

        wanted = joined((ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True))
        lists = neardup._lists(sets)
        batch = pa.RecordBatch.from_arrays([*(pa.array(np.zeros(size, np.int64)) for _ in range(4)), pa.array(ids), pa.array(ids), lists], names=list("fijsdcv"))
        found = [r for b in neardup._links(80, iter([batch.slice(0, 1), batch.slice(1)])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert joined(found) == wanted and len(found) < size
        side = np.arange(size) % 2
        across = joined((ids[i], ids[j]) for i, j in zip(*np.nonzero(near & (side[:, None] != side[None, :])), strict=True))
        found = neardup._block_links(ids, ids, side, lists.flatten().to_numpy(), lists.offsets.to_numpy(), 80)
        assert joined(found) == across
        rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int64)), pa.array(ids), pa.array(np.array([len(s) for s in sets])), neardup._lists([s[: neardup.K] for s in sets])], names=list("vine"))
        tested = joined(r for b in neardup._candidates(80, iter([rows.slice(0, 3), rows.slice(3)])) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        assert all(tested[int(ids[i])] == tested[int(ids[j])] for i, j in zip(*np.nonzero(near), strict=True))


def test_lower_percents_miss_no_links_of_long_documents(spark):
    rows = []
    for i in range(12):  # the first of three leads the lists of the others, but is no link (740 of 1260 words)
        common = [f"w{i}x{j}" for j in range(750)]
        own = [[f"v{i}x{k}x{j}" for j in range(260)] for k in range(3)]
        rows += [(3 * i, " ".join(common[:740] + own[0]), "en", "a"), *((3 * i + k, " ".join(common + own[k][:250]), "en", "a") for k in (1, 2))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), words=1, percent=60).collect()}
    assert got == {k: k - (k % 3 == 2) for k in range(36)}
    assert neardup.shared_at_least(80) == neardup.shared_at_least(95) == neardup.SHARED
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs(spark, rows), percent=20)


def test_texts_that_share_an_id_are_apart(spark):
    rnd = random.Random(3)
    a, b, c = (words_of(rnd, 300) for _ in range(3))
    near = {t: t + " and more" for t in (a, b)}
    texts = [(1, a), (1, b), (1, b), (2, near[a]), (3, near[b]), (4, c), (4, c + " end"), (5, ""), (5, c), (None, a)]
    given = docs(spark, [(k, t, "en", "a") for k, t in texts])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(given).collect())
    assert got == [(0, 0, True), *[(1, 1, True)] * 3, (2, 1, False), (3, 1, False), *[(4, 4, True)] * 2, (5, 4, False), (5, 5, True)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.drop_duplicates(given).collect())
    assert [x for x in kept if x[0] != 4] == sorted([(0, a), (1, a), (1, b), (5, "")]) and [x[0] for x in kept].count(4) == 1


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, words_of(rnd, rnd.randrange(60)), "en", rnd.choice(["a", "b", "c", None])) for i in range(300)]
    got = mixing.mix(docs(spark, rows)).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    assert sum(t for t, _ in by) == pytest.approx(1.5 * total)
    assert all(abs(sum(v) - t) <= 1 and t <= 2 * n for (t, n), v in by.items())
    odd = mixing.mix(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and mixing.mix(docs(spark, [])).isEmpty()
    mixed = mixing.apply(docs(spark, rows))
    assert mixed.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_mixed_rows_without_an_id_are_taken_as_planned(spark):
    rows = [(None, f"{s} {i} c d", "en", s) for i in range(40) for s in ("a", "b", "c")] + [(7, "a x y z", "en", "a"), (7, "b x y z", "en", "b")]
    planned = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        planned[r["target"], r["source_size"]] = planned.get((r["target"], r["source_size"]), 0) + r["taken"]
    mixed = {}
    for r in mixing.apply(docs(spark, rows)).collect():
        assert r["text"][0] == r["source"]
        mixed[r["source"]] = mixed.get(r["source"], 0) + len(r["text"].split())
    assert sorted(mixed.values()) == sorted(planned.values())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [warc.ArcRecord("http://a/ b\n", "1.2.3.4", "20010203", "text/html", "200", "-", b) for b in (b"", b"\n\nx\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nhi")]
    back = list(warc.parse_arc(warc.write_arc(records, version)))
    assert [r.block for r in back] == [r.block for r in records]
    assert warc.iso(back[0].date) == "2001-02-03T00:00:00Z"


def test_arc_files_are_read_whatever_their_state(spark, tmp_path):
    records = [warc.ArcRecord(f"http://h/{i}", "1.2.3.4", "20010203040506", "text/html", "200", "-", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i) for i in (0, 5, 9)]
    one, two = (warc.write_arc(records, v) for v in (1, 2))
    blank = one.replace(b"http://h/5 ", b"http://h/5 a b ")
    (tmp_path / "a.arc").write_bytes(one)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(two[:300]) + gzip.compress(two[300:]))
    (tmp_path / "c.arc").write_bytes(blank + two)
    (tmp_path / "d.arc").write_bytes(one.replace(b"http://h/5 1.2.3.4 20010203040506", b"http://h/5 1.2.3.4 never"))
    (tmp_path / "e.arc").write_bytes(one[:-4])
    (tmp_path / "f.arc").write_bytes(b"")
    (tmp_path / "g.arc").write_bytes(one[one.index(b"\n\n") + 2 :])
    got = {}
    for place in sorted(tmp_path.iterdir()):
        rows = warc.read_arcs(spark, str(place)).collect()
        got[place.name[0]] = [(x["url"][-1:], x["payload_bytes"], bool(x["error"])) for x in rows]
    fine = [("0", 0, False), ("5", 5, False), ("9", 9, False)]
    assert got["a"] == got["b"] == got["g"] == fine and got["f"] == []
    assert got["c"] == [fine[0], ("b", 5, False), fine[2], *fine]
    assert got["d"] == [fine[0], ("", 0, True), fine[2]]
    assert got["e"] == [*fine[:2], ("9", 0, True)]
    out = f"{tmp_path}/out"
    warc.convert(warc.read_arcs(spark, str(tmp_path)), out)
    back = warc.read_back(spark, out).collect()
    assert len(back) == 19 and {r["record_type"] for r in back} == {"response"}  # without page ids nothing is referred to
    raw = gzip.decompress(next((tmp_path / "out").glob("part-*.gz")).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_archive(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "b c", None), (4, "", ""), (None, "u", "é\r\n\r\nWARC/1.1"), (5, "u", "z" * 200000)]
    got = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["record_type"] == "response" and got[3]["refers_to"] == 4
    assert got[None]["payload_digest"] == warc.digest("é\r\n\r\nWARC/1.1".encode()) and got[5]["payload_bytes"] == 200000
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
    many = [(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(300)]
    got = {r["page_id"]: r["refers_to"] for r in warc.archive(spark.createDataFrame([(*r, "x", "y") for r in many], "page_id long, url string, html string, key string, block string")).collect()}
    assert got == {i: None if i >= 293 else max(k for k in range(300) if k % 7 == i % 7) for i in range(300)}


def test_url_rules(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "http://example.net"), (3, "x"), (4, None), (5, "ftp://q.org/fr/#a"), (6, "http://xnet/"), (7, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: ("net/", "block")}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()} == want
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_by_join(pages, table).collect()} == want


def test_audio_round_trip_and_resync():
    for n in (0, 1, 64, 1417, 5000, 100000):
        payload = audio.padded(random.Random(n).randbytes(n))
        media = audio.write(payload)
        stream = audio.probe(media)
        assert audio.read_payload(media, stream) == payload
        assert stream.table["bytes"] == 144 + sum(h.size for h in stream.headers)
    damaged = bytearray(audio.write(bytes(20000)))
    damaged[audio.probe(bytes(damaged)).offsets[3]] = 0
    stream = audio.probe(bytes(damaged))
    assert stream.skipped == 1440 and stream.wrong == 0
    assert audio.probe(b"no audio at all").headers == []


def test_audio_rows(spark):
    got = audio.store_and_probe(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    empty = hashlib.sha256(bytes(64)).hexdigest()
    assert {r["payload_sha256"] for r in got if r["doc_id"] in (1, 2)} == {empty}


def test_audio_payload_that_looks_like_a_tag():
    """'TAG' at any byte near the end of a payload, so also 128 before the stream's end."""
    met = 0
    for n in (512, 64 * 1417):
        for at in range(n - 160, n - 3):
            payload = audio.padded(b"x" * at + b"TAG" + b"x" * (n - at - 3))
            media = audio.write(payload)
            met += media[-128:-125] == b"TAG"
            assert audio.read_payload(media, audio.probe(media)) == payload
    assert met == 2
    tag = b"TAG" + b"a title".ljust(30, b"\0") + bytes(95)
    for media in (audio.write(bytes(5000)), audio.write(bytes(5000))[:-40]):
        stream, plain = audio.probe(media + tag), audio.probe(media)
        assert stream.tags["v1:title"] == "a title" and stream.offsets == plain.offsets


def bitwise_crc(bits):
    """The frame checksum, a bit at a time, from the standard."""
    value = 0xFFFF
    for bit in bits:
        top = value >> 15 & 1 ^ bit
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def bits_of(raw):
    return [byte >> k & 1 for byte in raw for k in range(7, -1, -1)]


@pytest.mark.parametrize("layer, mode, covered", [(1, 3, 128), (1, 0, 256), (1, 1, 4 * (2 * 4 + 28)), (2, 3, 88 + 2 * 27)])
def test_audio_checksums_of_layers_one_and_two(layer, mode, covered):
    """MPEG 1, 32 kHz; layer I at 128 kbit/s, layer II mono at 56 kbit/s (table a), all allocated."""
    at = {1: 4, 2: 3}[layer]
    head = bytes([0xFF, 0xF0 | 4 - layer << 1 | 8, at << 4 | 2 << 2, mode << 6])
    h = audio.header(head)
    assert (h.layer, h.mono, h.protected) == (layer, mode == 3, True)
    body = b"\x5a\xff\x11\x77" * 500
    if layer == 2:
        body = b"\xff" * 2000
    body = body[: h.size - 6]
    if layer == 2:
        assert audio.allocation_of(h) == (4,) * 11 + (3,) * 12 + (2,) * 4 and sum(audio.allocation_of(h)) == 88
    crc = bitwise_crc(bits_of(head[2:]) + bits_of(body)[:covered])
    frame = head + crc.to_bytes(2) + body
    good, bad = audio.probe(frame * 3), audio.probe(frame + frame[:4] + (crc ^ 1).to_bytes(2) + body + frame)
    assert (good.checked, good.wrong, len(good.offsets)) == (3, 0, 3) and (bad.checked, bad.wrong) == (3, 1)


def test_audio_foreign_damaged_and_null_media(spark):
    good = audio.write(audio.padded(b"words"))
    damaged = bytearray(audio.write(bytes(20000)))
    damaged[audio.probe(bytes(damaged)).offsets[3]] = 0
    rows = [(1, 5, good), (2, 0, None), (3, 0, b""), (4, 0, b"no audio at all"), (5, 20000, bytes(damaged)), (6, 0, good[-200:])]
    given = spark.createDataFrame([(k, n, None if m is None else bytearray(m), "x") for k, n, m in rows], "doc_id long, n_bytes long, media binary, error string")
    got = {r["doc_id"]: r for r in audio.features(given).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 64
    assert (got[2]["error"], got[2]["feature"], got[2]["media_bytes"]) == ("no media", None, None)
    assert [(got[k]["error"], got[k]["payload_sha256"], got[k]["feature"]) for k in (3, 4)] == [("no stored payload", None, "no frames")] * 2
    assert got[5]["error"] == "damaged stream" and got[5]["duration_micros"] > 0
    assert audio.features(given.limit(0)).isEmpty()


def test_audio_columns_match_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i + 10, words_of(rnd, n) + rnd.choice(["", " \u00e9\u65e5"]), "en", "a") for i, n in enumerate([1, 3, 12, 13, 200, 3000])] + ODD
    media = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in audio.encode(docs(spark, rows)).collect()}
    for r in audio.store_and_probe(docs(spark, rows)).collect():
        raw = next((t or "").encode() for k, t, *_ in rows if k == r["doc_id"])
        whole = raw + bytes(max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        stored = media[r["doc_id"], len(raw)]
        frames = [k for k in r["frame_offsets"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["error"]) == (len(stored), hashlib.sha256(stored).hexdigest(), None)
        assert all(stored[k : k + 2] == b"\xff\xfa" for k in frames) and f"frames={len(frames)} samples={1152 * len(frames)}" in r["feature"]
        assert r["duration_micros"] == 1152 * len(frames) * 1_000_000 // 32000


def test_audio_tags_and_tables():
    body = audio.write(bytes(3000))
    frames = body[audio._id3v2(body, {}) :]
    text = b"TIT2" + (6).to_bytes(4) + b"\0\0" + b"\0title"
    for major, flags, extra, footer in ((3, 0, b"", b""), (3, 0x40, (6).to_bytes(4) + bytes(6), b""), (4, 0x50, (6).to_bytes(4) + bytes(2), b"3DI" + bytes(7))):
        inner = extra + text
        tag = b"ID3" + bytes([major, 0, flags, 0, 0, 0, len(inner)]) + inner + footer
        stream = audio.probe(tag + frames)
        assert stream.tags["TIT2"] == "title" and stream.skipped == 0 and stream.offsets[0] > len(tag)
    h = audio.header(frames[:4])
    size = max(audio._ROOMS) + audio._FRONT
    vbri = bytearray(audio._FRONTS[max(audio._ROOMS)].ljust(size, b"\0"))
    vbri[36:66] = b"VBRI" + bytes(6) + (9999).to_bytes(4) + (7).to_bytes(4) + (2).to_bytes(2) + (3).to_bytes(2) + (2).to_bytes(2) + (5).to_bytes(2) + (10).to_bytes(2) + (20).to_bytes(2)
    assert audio.probe(bytes(vbri) + frames[h.size :]).table == {"kind": "VBRI", "frames": 7, "bytes": 9999, "toc": [30, 60], "frames_per_entry": 5}
    lame = bytearray(audio._FRONTS[max(audio._ROOMS)].ljust(size, b"\0"))
    lame[audio._FRONT : audio._FRONT + 8] = b"Xing" + bytes(4)
    lame[audio._FRONT + 8 : audio._FRONT + 17] = b"LAME3.100"
    lame[audio._FRONT + 29 : audio._FRONT + 32] = (576 << 12 | 1000).to_bytes(3)
    stream = audio.probe(bytes(lame) + frames[h.size :])
    assert (stream.table["delay"], stream.table["padding"]) == (576, 1000)
    assert stream.micros == (stream.samples - 1576) * 1_000_000 // 32000


def test_url_tables_of_rules_match_the_index(spark):
    rnd = random.Random(7)
    hosts = ["a.b.net", "net", "b.net", "x.a.b.net", "c.org", "org"]
    rules = {f"{rnd.choice(hosts)}/{''.join(rnd.choice('ab/') for _ in range(rnd.randrange(4)))}": rnd.choice(["block", "allow"]) for _ in range(40)}
    rows = [(i, f"http://{rnd.choice(['', 'w.', 'A.'])}{rnd.choice(hosts)}/{''.join(rnd.choice('ab/') for _ in range(6))}") for i in range(300)] + [(None, None), (1, "x"), (1, "x")]
    pages = spark.createDataFrame([(k, u, "r") for k, u in rows], "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules.items(), (None, "block"), ("no slash", "block"), ("net/", None)], "rule string, verdict string")
    want = sorted(map(str, urls.judge(pages, rules).collect()))
    assert sorted(map(str, urls.judge_by_join(pages, table).collect())) == want
    assert urls.judge(pages.limit(0), rules).isEmpty() and urls.judge_by_join(pages.limit(0), table).isEmpty()


def test_statistics_match_plain_counting():
    rnd = random.Random(9)
    texts = ["word", " ", "A b\nA b\n\nc | d! 7,5.", "\u00e9\u65e5 x", *("".join(rnd.choice("aB 1\n.,!?|#\u00e9\t") for _ in range(rnd.randrange(1, 200))) for _ in range(200))]
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",", "!?", "|"]
    for text in texts:
        size = len(text.encode())
        share = [sum(c in one for c in text) / size for one in sets]
        share.append(sum(33 <= ord(c) < 127 and not any(c in one for one in sets) for c in text) / size)
        share.append(sum(len(c.encode()) for c in text if ord(c) > 127) / size)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        pairs = {(a, b) for a, b in zip(words, words[1:], strict=False)}
        n, m = max(1, len(words)), max(1, len(lines))
        long = [len(w.encode()) for w in words]
        want = [*share, np.log1p(len(words)), sum(long) / n, np.log1p(max(long, default=0)), len(set(words)) / n, len(pairs) / max(1, n - 1), len(set(lines)) / m, np.log1p(size / m), np.log1p(max((len(x.encode()) for x in lines), default=0)), share[0] / max(1e-9, share[0] + share[1])]
        assert quality.statistics(text) == pytest.approx(want, abs=1e-12), repr(text)


def test_quality_fit_is_bounded_in_rows_and_defined_for_repeats(spark):
    given = docs(spark, [(1, f"text {i}", "en", "a") for i in range(50)] + [(2, "one", "en", "a"), (2, "one", "en", "a"), (3, None, None, None)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    seen = []
    original, quality.fit = quality.fit, lambda x, y: seen.append((len(x), sorted(y.tolist()))) or original(x, y)
    try:
        quality.train(given, labels)
        quality.train(given, labels, sample=1)
        quality.train(given.limit(0), labels)
    finally:
        quality.fit = original
    assert [n for n, _ in seen] == [3, 1, 0] and seen[0][1] == [0.0, 1.0, 1.0]


def test_language_distances_match_plain_counting():
    rnd = random.Random(10)

    def ranked(text, n):
        words = re.findall(r"[^\W\d_]+", text.lower())
        line = [" ", *(c for w in words for c in [*w, " "])]
        grams = Counter(c for c in line if c != " ")
        grams.update("".join(line[i : i + 2]) for i in range(len(line) - 1))
        grams.update("".join(line[i : i + 3]) for i in range(len(line) - 2) if line[i + 1] != " ")
        return sorted(grams, key=lambda g: (-grams[g], len(g), g))[:n] if words else []

    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "\u00e9\u00e8xyzab"}
    taught = {lang: " ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(1, 6))) for _ in range(300)) for lang, a in alphabets.items()}
    n = 40
    profiles = langid.profiles_of({lang: langid.ngrams(t) for lang, t in taught.items()}, n)
    places = {lang: {g: i for i, g in enumerate(ranked(t, n))} for lang, t in taught.items()}
    for _ in range(100):
        text = "".join(rnd.choice("abcdefgxyz\u00e9 .1\n") for _ in range(rnd.randrange(60)))
        mine = ranked(text, n)
        apart = {lang: sum(abs(p[g] - i) if g in p else n for i, g in enumerate(mine)) for lang, p in places.items()}
        lang, score = profiles.predict(text)
        best = min(sorted(apart), key=apart.get)
        assert (lang, score) == ((best, pytest.approx(1 - apart[best] / (n * len(mine)))) if mine else ("und", 0.0)), repr(text)


CLASHES = ["row", "word", "bit", "bits", "maybe", "mark", "set_id", "h", "part", "k0", "k1", "size", "taken", "at", "kept", "pass", "n", "n_shingles", "component_id", "score", "predicted", "p", "lang_pred", "held_out", "id", "value", "doc", "media", "feature", "position", "again", "rank", "__size", "__words", "__lang", "__score", "stays"]


def operators(spark):
    one = quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0))
    profiles = langid.profiles_of({"en": langid.ngrams("the house of words"), "de": langid.ngrams("das haus der worte")})
    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "quality": lambda d: quality.classify(d, one),
        "language": lambda d: langid.identify(d, profiles),
        "learned language": lambda d: langid.identify(d, langid.train(d)),
        "mixing": mixing.mix,
        "mixed": mixing.apply,
        "near duplicates": neardup.near_duplicates,
        "without duplicates": neardup.drop_duplicates,
        "packing": lambda d: packing.pack(d, path).drop("sequence_id", "offset"),
        "tokens": lambda d: tokens.token_counts(d, path),
        "audio": audio.store_and_probe,
        "language stage": lambda d: corpus_pipeline.language_id(spark, d, "/root/testdata/sf0.001"),
        "quality stage": lambda d: corpus_pipeline.quality_filter(spark, d, "/root/testdata/sf0.001"),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_empty_tables_and_clashing_columns(spark, name):
    run = operators(spark)[name]
    plain = docs(spark, ODD + [(7, "The same words. " * 9, "en", "a"), (8, "The same words. " * 9, "de", "a"), (7, "Other words at last", "en", "b")]).select("doc_id", "text", "lang", "source")
    empty = run(plain.limit(0))
    assert empty.isEmpty()
    mixed = plain.withColumns({c: plain.text for c in CLASHES})
    columns = empty.columns
    want = sorted(map(str, run(plain).select(*columns).collect()))
    rows = run(mixed)
    assert sorted(map(str, rows.select(*columns).collect())) == want
    if columns == plain.columns:
        assert rows.columns == mixed.columns


def test_vectors_of_an_empty_table_and_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (None, [1.0, 0.0], "x")], "vec_id long, embedding array<float>, v string")
    more = rows.withColumns({c: rows.v for c in ("id", "n", "width", "links", "ok", "component_id", "kept")})
    want = [(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert sorted(map(tuple, vectors.near_duplicates(more).collect()), key=str) == sorted(want, key=str)
    assert vectors.near_duplicates(rows.limit(0)).isEmpty()


def test_folds_are_defined_for_null_ids(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for run, of, which in ((queries.op1_quality_classifier, 4, 2), (queries.op2_language_id, 5, 0)):
        for r in run(spark, str(tmp_path)).collect():
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % of == which)


def test_steps_leave_only_what_a_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = neardup.near_duplicates(docs(spark, ODD + [(9, "a b c d e f", "en", "a"), (10, "a b c d e f", "en", "a")])).collect()
    assert len(rows) == len(ODD) + 2 and len(list(tmp_path.iterdir())) == 2
