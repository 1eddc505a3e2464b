import random
import re

import pytest

from scrubline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, own = [False] * len(w), set()
        for item, t in items:
            b = words(t)
            n = min(window, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit[k : k + n] = [True] * n
                    own.add(str(item) if item is not None else "null")
        out.append((i, len(w), sum(hit), sorted(own), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def fixture(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "é", "x1", "The", "ZZ"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 5, 13, 14, 20, 40]))) for k in range(12)] + [(None, text(15)), (3, None)]
    docs = []
    for k in range(40):
        t = text(r.choice([0, 2, 14, 60]))
        if k % 3 == 0 and items[k % 12][1]:
            t += ", " + items[k % 12][1].upper() + "! " + text(30)
        docs.append((k, t))
    return docs + [(None, None), (7, ""), (1, docs[0][1]), (1, docs[0][1])], items


@pytest.mark.parametrize("seed,block", [(1, 8 << 20), (2, 100)])
def test_matches_equal_brute_force(spark, seed, block):
    docs, items = fixture(seed)
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(d, b, block_bytes=block).collect()
    key = lambda r: repr(r)
    assert sorted([tuple(r)[:4] + (r["contaminated"],) for r in got], key=key) == sorted(brute(docs, items), key=key)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    kept = decontam.decontaminated(d, b, block_bytes=block)
    assert kept.columns == d.columns
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=key) == sorted(
        [x for x, v in zip(docs, brute(docs, items)) if not v[4]], key=key)


def test_small_shards_give_the_same(spark, monkeypatch):
    docs, items = fixture(5)
    block = decontam.Block([(str(i), t.encode() if t else None) for i, t in items], 13)
    whole = [decontam.words_of(t.encode() if t else None) for _, t in docs]
    at_once = {(d, s, e) for d, s, e, _ in decontam._hits(whole, block)}
    alone = {(k, s, e) for k, w in enumerate(whole) for _, s, e, _ in decontam._hits([w], block)}
    assert at_once == alone


def test_no_items_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    row = decontam.matches(d, b).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (3, 0, [], False)
    assert decontam.matches(d.limit(0), b).count() == 0
    assert decontam.decontaminated(d.limit(0), b).count() == 0


def test_longest_match_is_found():
    block = decontam.Block([("1", b"q w e r t y")], 13)
    flat = [w.split() for w in (b"w e r x", b"t y q w")]
    import numpy as np

    words_flat = np.concatenate([*(np.append(block.numbers(w), 0) for w in flat), np.zeros(block.depth)]).astype(">u4")
    block.shortest = 1
    best, _ = decontam.SuffixArray(words_flat, block).longest(block.suffixes)
    assert sorted(best.tolist()) == sorted([2, 3, 2, 1, 2, 1])
