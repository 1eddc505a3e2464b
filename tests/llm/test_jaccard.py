import random

import numpy as np
import pytest

from scrubline.llm import jaccard


def shingles(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, percent=90, k=3):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(docs, sets))), key=repr)


def fixture(seed, copies=12):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "a", "É", "x", "y"] + [f"w{k}" for k in range(400)]
    text = lambda n: r.choices(vocab, k=n)
    docs = [text(r.choice([1, 2, 3, 8, 30, 60, 120])) for _ in range(60)]
    for base in (text(200), text(100), text(60)):
        docs.append(base)
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = r.choice(vocab)
            docs.append(own)
            if r.random() < 0.3:
                docs.append(own + text(r.choice([1, 3, 12])))
    passage = text(80)
    docs += [passage + text(r.choice([2, 5, 9, 20])) for _ in range(copies)]
    r.shuffle(docs)
    rows = [(k + 3, r.choice([" ", "\t", "  \n"]).join(w).upper() if r.random() < 0.2 else " ".join(w)) for k, w in enumerate(docs)]
    return rows + [(None, rows[2][1]), (None, None), (1, ""), (1, " \n"), (5, rows[7][1]), (5, rows[7][1]), (2, "a"), (9, "A"), (4, "a b")]


@pytest.mark.parametrize("seed,paired,frequent,most", [(1, 32, 32, 500_000), (2, 3, 4, 500_000), (3, 2, 1, 5), (4, 2, 10**6, 10), (5, 4, 2, 500_000)])
def test_equals_brute_force(spark, seed, paired, frequent, most, monkeypatch):
    docs = fixture(seed)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", most)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, uid string, n int").repartition(3)
    got = jaccard.similar(d)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_other_thresholds(spark):
    docs = fixture(8)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(d, shingle=5, percent=80).collect()), key=repr) == brute(docs, 80, 5)


def test_what_pivots_do_not_connect_is_compared(spark, monkeypatch):
    """A chain: neighbours are similar, the ends are not, and every text shares one prefix."""
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    words = [f"w{k}" for k in range(160)]
    docs = [(k, " ".join(words[2 * k : 2 * k + 102])) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similar(d).collect()), key=repr)
    assert got == brute(docs) and {c for _, _, c in got} == {0}


def test_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar(d).count() == 0
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(d).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_long_text_and_order_of_words():
    hashes = jaccard._WordHashes()
    a = jaccard.shingle_set(b"a b c".split(), 3, hashes)
    assert len(a) == 1 and a[0] != jaccard.shingle_set(b"c b a".split(), 3, hashes)[0]
    assert jaccard.shingle_set([b"a"], 3, hashes)[0] != jaccard.shingle_set([b"a", b"a"], 3, hashes)[0]
    many = [str(k).encode() for k in range(100_000)]
    assert len(jaccard.shingle_set(many + many, 3, hashes)) == 100_000
    assert np.all(np.diff(jaccard.shingle_set(many, 3, hashes)) > 0)


@pytest.mark.parametrize("known", [0, 1, 64])
def test_a_pair_is_found_in_the_first_wide_list_it_shares(spark, known, monkeypatch):
    """Near copies that pivots do not connect meet in one list, not in each that they share."""
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "KNOWN", known)
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(40):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            own[r.randrange(len(own))] = f"x{r.randrange(6)}"
        docs.append((k, " ".join(own)))
    tables, stored = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name="stored": tables.setdefault(name, stored(df, name)) if name == "open-rows" else stored(df, name))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(d).collect()), key=repr) == brute(docs)
    lists = {}
    for x in tables["open-rows"].collect():
        lists.setdefault((x["x"], x["y"]), []).append(x["a"])
    met = [(a["uid"], b["uid"]) for rows in lists.values() for a in rows for b in rows if a["uid"] < b["uid"] and not set(a["before"]) & set(b["before"])]
    assert met and (known < 64 or len(met) == len(set(met)))
