import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrubline.catalog.registry import table
from scrubline.llm import lang_cnn, quality_ordinal, simhash
from scrubline.llm.components import connected_components
from scrubline.llm.queries import op5_quality_classifier, op8_lang_cnn


def fp(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("paired", [32, 2])
def test_near_duplicates_equal_brute_force(spark, paired):
    r = random.Random(8)
    texts = [None, "", "one", "One two", "ONE two three four five"]
    for _ in range(12):
        t = [f"w{r.randrange(500)}" for _ in range(60)]
        for _ in range(r.randrange(1, 9)):
            u = list(t)
            for _ in range(r.randrange(3)):
                u[r.randrange(60)] = "zz"
            texts.append(" ".join(u))
    rows = [(k * 7 % 101, t, "x") for k, t in enumerate(texts)] + [(None, texts[9], "x"), (50, texts[9], "x"), (50, texts[9], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df, paired=paired).collect()
    roots = closed({fp(t) for _, t, _ in rows}, 4)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            x = roots[fp(t)]
            least[x] = min(least.get(x, i), i)
    want = [(i, fp(t), least.get(roots[fp(t)])) for i, t, _ in rows]
    assert sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got], key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # One row for each component, chosen by id (null last), then hash of the text.
    hashed = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    best = {}
    for i, t, *_ in rows:
        key = (i is None, i or 0, hashed[t])
        best[roots[fp(t)]] = min(best.get(roots[fp(t)], (key, i, t)), (key, i, t), key=lambda x: x[0])
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((i, t) for _, i, t in best.values()), key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = [m % 2**64 for m in simhash.covering_masks(radius)]
    r = random.Random(radius)
    for _ in range(3000):
        flipped = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not m & flipped for m in masks)


@pytest.mark.parametrize("radius", [3, 4])
def test_links_of_crowded_fingerprints(spark, radius):
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(150)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {x["node"] % 2**64: x["root"] for x in connected_components(simhash.links(df, radius, paired=3)).collect()}
    want = closed(fps, radius)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(roots.get(f, signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_keys_of_all_tables_are_not_broadcast(spark, fresh_path, monkeypatch, capsys):
    kept = simhash.stored

    def shown(df, name):
        if name == "buckets":
            df.explain()
        return kept(df, name)

    monkeypatch.setattr(simhash, "stored", shown)
    path = fresh_path()
    spark.range(500).selectExpr("xxhash64(id div 2) ^ (id % 2 * 5) as fp").write.parquet(path)
    found = simhash.links(spark.read.parquet(path), 4)
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["a"] ^ r["b"]) for r in found.collect()} == {5} and found.count() == 250


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(7, None), (5, 5)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {n: n for n in near}
    for _ in range(100):
        root = {n: min([root[n], *(root[m] for m in near[n])]) for n in near}
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ordinal_fit_orders_grades_and_thresholds(spark):
    r = random.Random(2)
    filler = [f"w{k}" for k in range(300)]
    rows, grades = [], []
    for k in range(600):
        g = k % 3
        rows.append((k, " ".join(r.sample(filler, 30) + [f"mark{g}"] * 2), "x"))
        grades.append((k, g if k % 50 else None, "y"))
    docs = spark.createDataFrame(rows + [(None, None, "x"), (900, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, tail string")
    ratings = spark.createDataFrame(grades + [(None, 1, "y"), (12345, 2, "y"), (1, 9, "y")], "doc_id long, grade int, text string")
    model = quality_ordinal.train(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {x["doc_id"]: x for x in quality_ordinal.judged(docs, model, min_grade=1).collect()}
    assert np.mean([round(got[k]["expected_grade"]) == k % 3 for k in range(600)]) > 0.97
    assert all(got[k]["selected"] == (got[k]["tail"] >= 0.5) for k in got)
    kept = quality_ordinal.select(docs, model, 1)
    assert kept.columns == docs.columns and 300 < kept.count() < 480
    none = quality_ordinal.train(docs, ratings.limit(0), 3)
    even = quality_ordinal.judged(docs, none, 2).first()
    assert abs(even["tail"] - 1 / 3) < 1e-9 and abs(even["expected_grade"] - 1) < 1e-9
    assert quality_ordinal.judged(docs.limit(0), model, 1).count() == 0


def test_quality_of_labels_it_was_taught(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["selected"] for r in op5_quality_classifier(spark, folder).collect()}
    labels = table(spark, folder, "labels").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_toxic_documents_do_not_pass_the_quality_stage(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality_ordinal.train(docs, quality_ordinal.grades_of(labels.where(~out)), n_grades=3)
    monkeypatch.setattr(corpus_pipeline, "quality_model", lambda *_: model)
    held = labels.where(out).collect()
    stay = {r["doc_id"] for r in corpus_pipeline.rate(spark, docs, folder).select("doc_id").collect()}
    share = lambda q, t: np.mean([r["doc_id"] in stay for r in held if r["toxic"] == t and r["quality"] == q])
    assert share(1, 1) < 0.4 and share(0, 1) < 0.1 and share(1, 0) > 0.95
    judged = {r["doc_id"]: r["tails"] for r in quality_ordinal.judged(docs, model, min_grade=1).collect()}
    assert all(a >= b for a, b in judged.values()) and stay == {i for i, (_, b) in judged.items() if b >= 0.5}


def test_languages_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op8_lang_cnn(spark, folder).collect()}
    docs = table(spark, folder, "documents").collect()
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1) for d in docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"] and d["lang"]]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_of_odd_texts(spark):
    rows = [(1, "der die das und", "de", 1), (2, "the and of to", "en", 1), (None, None, None, 1), (3, "", "en", 1), (4, "12 !?", "en", 1),
            (5, "the " * 30_000, "en", 1), (1, "der die das und", "de", 1), (6, "é", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = lang_cnn.train(df)
    got = lang_cnn.predicted(df, net).collect()
    und = {(r["doc_id"], r["score"]) for r in got if r["lang_pred"] == "und"}
    assert und == {(None, 0.0), (3, 0.0), (4, 0.0)} and len(got) == len(rows)
    assert {r["lang_pred"] for r in got} <= {"und", "de", "en"}
    blank = lang_cnn.train(df.where("lang is null"))
    assert {(r["lang_pred"], r["score"]) for r in lang_cnn.predicted(df, blank).collect()} == {("und", 0.0)}
    assert lang_cnn.predicted(df.limit(0), net).count() == 0


def plain_predict(net, text):
    """Every window by itself, every filter as a sum over its bytes."""
    raw, window, widest = text.lower().encode(), lang_cnn.WINDOW, max(lang_cnn.WIDTHS)
    total, mass = np.zeros(len(net.languages)), 0
    for at in range(0, len(raw), window):
        padded = raw.ljust(at + window + widest, b" ")
        best = np.full(net.kernel.shape[1], -np.inf)
        for start in range(at, at + window):
            seen = np.concatenate([net.embedding[b] for b in padded[start : start + widest]])
            best = np.maximum(best, seen @ net.kernel)
        z = np.maximum(best + net.bias, 0) @ net.dense + net.offset
        chance = np.exp(z - z.max())
        held = min(window, len(raw) - at)
        total, mass = total + chance / chance.sum() * held, mass + held
    return net.languages[int(total.argmax())], total.max() / mass


def test_predictions_equal_a_plain_convolution(spark, sf):
    docs = table(spark, sf, "documents")
    net = lang_cnn.train(docs)
    texts = [r["text"][:1500] for r in docs.limit(30).collect()] + ["a", "é" * 100, "x" * 127, "x y" * 43, "The " * 400]
    for text, (lang, score) in zip(texts, net.predict(texts)):
        want, chance = plain_predict(net, text)
        assert lang == want and abs(score - chance) < 1e-3, text[:40]


def test_letters_are_letters_only(spark):
    rows = [(k, t, "en") for k, t in enumerate(["½", "²", "Ⅷ", "一", "ª", "1 ½ ² !", "\u0301", "word"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in lang_cnn.predicted(df, lang_cnn.train(df)).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en", 5: "und", 6: "und", 7: "en"}


def test_the_most_frequent_languages_are_taught(spark):
    rows = [(k, f"some words {k}", f"l{k % 600:03d}") for k in range(700)] + [(1000 + k, "der die das", "de") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = lang_cnn.train(df, max_languages=3)
    assert net.languages == ["de", "l000", "l001"]
    assert lang_cnn.predicted(df, net).where("lang_pred not in ('de', 'l000', 'l001')").count() == 0


def test_network_gradient_learns():
    r = random.Random(1)
    make = lambda c: bytes(r.choice(c) for _ in range(40))
    windows = [make(b"abc ") for _ in range(80)] + [make(b"xyz ") for _ in range(80)]
    net = lang_cnn.fit(windows, ["a"] * 80 + ["x"] * 80)
    assert [p for p, _ in net.predict(["abcab cab", "zyx zyx", "a" * 1000])] == ["a", "x", "a"]


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf)
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left <= ids and after.count() == len(left)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns
            docs, ids = after, left
    assert after.columns == ["doc_id", "ids"]
    assert after.count() == corpus_pipeline.run(spark, sf).count()
