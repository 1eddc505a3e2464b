import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scrubline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, b in bags:
            m = 25 + 75 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m))
                    for w in terms(text) if w in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def fixture(seed, n=300):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["The", "É", "été", "ÀB", "x1", "日本"]
    shares = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda size: "  ".join(r.choices(vocab, shares, k=size)) + "."
    docs = [(k, text(r.choice([0, 1, 3, 10, 60]))) for k in range(n)]
    docs += [(1000 + k, docs[k % 3 + 5][1]) for k in range(60)]
    docs += [(None, text(9)), (None, None), (7, ""), (7, docs[8][1]), (8, "THE the " * 5000), (9, "... !")]
    items = [(k, text(r.choice([0, 1, 4, 12]))) for k in range(25)] + [(None, text(5)), (3, None), (4, text(6)), (30, "nowhere at all"), (31, "The")]
    return docs, items + [items[2], items[2]]


@pytest.mark.parametrize("seed,shard,block,k", [(1, 16 << 20, 200_000, 10), (2, 300, 20, 10), (3, 1, 7, 3)])
def test_equals_brute_force(spark, seed, shard, block, k, monkeypatch):
    docs, items = fixture(seed)
    monkeypatch.setattr(lexical, "FIRST_WAVE", 1)
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(lexical.build(d, shard_bytes=shard), q, k=k, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, items, k), key=repr)


def test_strata_that_cannot_win_are_not_visited():
    counts = [np.array([0] * n) for n in (1, 2, 4, 40, 80)] + [np.array([1])]
    import pyarrow as pa

    numbers = lexical._Numbers({b"a": 0, b"b": 1})
    raw = lexical._shard(pa.array(range(6)), counts, numbers, 6, 128)
    raw["terms"] = list(numbers)
    shard = lexical._Shard(raw, {b"a": 0}, 1)
    q = lexical._Query(1, np.array([0]), np.array([10]))
    every = shard.best(q, 10, 0)
    assert len(every) == 5
    high = max(every)[0]
    assert [s for s, _ in shard.best(q, 1, high)] == [high]
    assert shard.best(q, 1, high + 1) == []


def test_no_documents_no_queries_and_other_ids(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", "y z z"), (None, "z")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "z x")], "item_id string, text string")
    index = lexical.build(d)
    assert [tuple(r) for r in lexical.search(index, q).orderBy("rank").collect()] == [
        tuple(x) for x in sorted(brute([("a", "x y"), ("b", "y z z"), (None, "z")], [("q", "z x")]), key=lambda x: x[1])]
    assert lexical.search(index, q.limit(0)).count() == 0
    assert lexical.search(lexical.build(d.limit(0)), q).count() == 0


def test_a_row_group_holds_few_shards(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical, "GROUP_BYTES", 3, raising=False)
    docs, _ = fixture(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    paths = [p.removeprefix("file://") for p in lexical.build(d, shard_bytes=1).table.inputFiles()]
    footers = [pq.ParquetFile(p).metadata for p in paths]
    assert sum(m.num_rows for m in footers) > 100
    assert {m.row_group(i).num_rows for m in footers for i in range(m.num_row_groups)} <= {1, 2, 3}
