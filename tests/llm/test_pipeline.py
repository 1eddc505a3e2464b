"""The pipeline's rows against a plain version of every stage."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import test_decontam
import test_models
import test_pii
import tiktoken

import corpus_pipeline
from scrubline.llm import quality_ordinal
from scrubline.llm.queries import byte_vocabulary, quality_model

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def plain_tails(text, model):
    """P(grade >= k) from counts in plain dictionaries."""
    words = (text or "").split()
    bucket = lambda feature: zlib.crc32(feature.encode()) % quality_ordinal.BUCKETS
    per_word = quality_ordinal.SHAPE_SCALE / max(1, len(words))
    score = sum(a == b for a, b in zip(words, words[1:])) * per_word * model.weights[bucket("r")]
    for word, n in Counter(words).items():
        shape = re.sub(r"[^\W\d_]+", "A" if len(word) > 1 and word.isupper() else "a", word)
        score += math.log1p(n) * model.weights[bucket("w" + re.sub(r"^\W+|\W+$", "", word).lower())]
        score += n * per_word * model.weights[bucket("s" + re.sub(r"\d+", "0", shape)[:24])]
    return [1 / (1 + math.exp(t - score)) for t in model.thresholds]


def log_likelihood(model, rows):
    """Of graded rows, every grade with equal weight, less the penalty of the weights."""
    share, total = Counter(g for _, g in rows), 0.0
    for text, g in rows:
        tails = [1.0, *plain_tails(text, model), 0.0]
        total += math.log(max(tails[g] - tails[g + 1], 1e-9)) / (share[g] * len(share))
    return total - quality_ordinal.RIDGE / 2 * float(np.dot(model.weights, model.weights))


def graded():
    r = random.Random(5)
    filler = [f"w{k}" for k in range(60)]
    return [(" ".join(r.sample(filler, 12) + [f"mark{k % 3 if r.random() < 0.8 else r.randrange(3)}"]), k % 3) for k in range(400)]


def test_chances_equal_plain_counts(spark):
    rows = graded()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = quality_ordinal.train(docs, spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int"), 3)
    texts = [t for t, _ in rows[:40]] + [None, "", "a a a B2 B2!", "MARK1 mark1. “x” 12-34", "mark2 " * 5000, "z" * 20_000]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_ordinal.judged(given, model, min_grade=2).collect():
        want = plain_tails(texts[r["doc_id"]], model)
        assert r["tails"] == pytest.approx(want) and r["tail"] == pytest.approx(want[1]) and r["expected_grade"] == pytest.approx(sum(want))
        assert r["selected"] == (r["tail"] >= 0.5)


def test_the_fit_is_near_the_top_of_a_plain_likelihood(spark):
    rows = graded()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = quality_ordinal.train(docs, spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int"), 3)
    best = log_likelihood(model, rows)
    none = quality_ordinal.Model(np.zeros_like(model.weights), model.thresholds)
    assert best > log_likelihood(none, rows) + 0.1
    for at in np.argsort(-np.abs(model.weights))[:3]:
        for step in (-2.0, 2.0):
            other = model.weights.copy()
            other[at] += step
            assert log_likelihood(quality_ordinal.Model(other, model.thresholds), rows) < best
    for step in (-0.5, 0.5):
        assert log_likelihood(quality_ordinal.Model(model.weights, model.thresholds + step), rows) < best


def small_tables(spark, folder):
    r = random.Random(12)
    words = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(k, text(20)) for k in range(4)] + [(None, text(15)), (9, None)]
    docs, labels = [], []
    for k in range(150):
        g = k % 3
        docs.append([k, text(40) + f" mark{g} mark{g}"])
        labels.append((k, 0 if g == 0 else 1, 1 if g == 1 else 0))
    for k in range(2, 60, 3):  # copies of good documents, some with another word at the end
        docs.append([1000 + k, docs[k][1] + (" extra" if k % 2 else "")])
    for k in range(6):  # with a passage of an item
        docs.append([2000 + k, text(30) + " " + items[k % 4][1] + " mark2 mark2"])
    for k in range(8):
        docs.append([3000 + k, text(30) + f" account holder mail: u{k}@mail.org then mark2 mark2 é"])
    docs.append([3100, text(30) + " account holder mail: user_4711x then mark2 mark2"])
    docs.append([3200, text(30) + " " + "ab12" * 10 + " mark2 mark2"])
    docs += [[None, docs[5][1] + " null id"], [None, docs[5][1] + " null id"], [None, None], [4000, ""], [8, text(40) + " mark2 mark2"], [8, docs[8][1]]]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in docs]
    for name, made, schema in (
        ("documents", rows, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(made, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return [(i, t) for i, t, *_ in rows], items


def plain_keep_one(spark, docs):
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in docs], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    roots, best = test_models.closed({test_models.fp(t) for _, t in docs}, 4), {}
    for i, t in docs:
        key = (i is None, i or 0, hashed[t])
        root = roots[test_models.fp(t)]
        if root not in best or key < best[root][0]:
            best[root] = (key, (i, t))
    return [row for _, row in best.values()]


def plain_redacted(docs):
    added, out = test_pii.bootstrapped(docs), []
    names = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "id": "[ID]"}
    for (i, text), (_, more) in zip(docs, added):
        spans = sorted([(s, rank, e, kind) for s, rank, e, kind in test_pii.brute(text)] + [(s, 4, e, "id") for s, e in more])
        made, at = "", 0
        for s, _, e, kind in spans:
            if s >= at:
                made += (text or "")[at:s] + names[kind]
            at = max(at, e)
        out.append((i, None if text is None else made + text[at:]))
    return out


def test_rows_equal_plain_stages(spark, fresh_path):
    folder = fresh_path()
    docs, items = small_tables(spark, folder)
    key = lambda x: repr(x)
    model = quality_model(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    want = [(i, t) for i, t in docs if plain_tails(t, model)[1] >= 0.5]
    assert {k for k in range(150) if k % 3 == 2} <= {i for i, _ in want} and not {k for k in range(150) if k % 3 != 2 and k != 8} & {i for i, _ in want}
    by_stage = [want]
    by_stage.append(plain_keep_one(spark, by_stage[-1]))
    by_stage.append([x for x, v in zip(by_stage[-1], test_decontam.brute(by_stage[-1], items)) if not v[4]])
    by_stage.append(plain_redacted(by_stage[-1]))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES, by_stage):
        now = stage(spark, now, folder)
        assert now.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        got = now.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(rows, key=key), name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert len(by_stage[0]) > len(by_stage[1]) > len(by_stage[2]) and any("[ID]" in (t or "") for _, t in by_stage[3])
    codes = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_vocabulary().ranks, special_tokens={})
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], r["ids"]) for r in whole.collect()), key=key) == sorted(
        ((i, codes.encode_ordinary(t or "")) for i, t in by_stage[3]), key=key)


def test_empty_tables(spark, fresh_path):
    folder = fresh_path()
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
