import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for rank, (kind, pattern, ok) in enumerate((
        ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    )):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if ok(m[0])]
    return sorted(out)


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x.y%z@q-1.example.com@", "é😀 me@x.org, 1.2.3.4 and 256.1.1.1 001.002.003.004.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-6789 +12 +1.2.3.4", "+49 30 1234567890123456", "@@ a@ @b.c",
    "1.2.3.4.5.6.7.8 0000.1.1.1 ..1.1.1.1", "x" * 30_000 + "@", "9" * 30_000, "a@b" + ".c" * 4_000, "1 " * 400,
    " ".join(f"u{k}@h{k}.org" for k in range(700)), "+1-2+3 45 67 89 01 (2)3",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "a@b.c", "y"), (3, TEXTS[3], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    return rows, pii.spans(df).collect()


def test_base_spans_equal_plain_patterns(found):
    rows, got = found
    key = lambda x: repr(x)
    want = sorted([(i, brute(t)) for i, t, _ in rows], key=key)
    assert sorted([(r["doc_id"], [tuple(s) for s in r["base"]]) for r in got], key=key) == want
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)


def test_running_totals(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(pii.running(
            F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x % 7)).alias("x")).first()
        values, at, want = [(k + 1) % 7 for k in range(n)], 0, []
        for v in values:
            want.append(at)
            at += v
        assert row["x"] == want


def test_contexts_find_unseen_identifiers_and_leave_clean_text(spark):
    known = [(k, f'note {k % 5} words account holder mail: u{k}@mail.org then more') for k in range(12)]
    unseen = [(100, "other words account holder mail: user_4711x then more"), (101, "version 2.0.1 of 1999 and page 12345678 is clean")]
    rows = pii.spans(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()
    added = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "id"] for r in rows}
    start = unseen[0][1].index("user_4711x")
    assert added[100] == [("id", start, start + 10)]
    assert all(not v for k, v in added.items() if k != 100)


MENTION = re.compile(
    r"(?<![^\s\"'<>()\[\]{},;=])(?=[^\s\"'<>()\[\]{},;=@0-9]*[@0-9])[^\s\"'<>()\[\]{},;=]{5,}[^\s\"'<>()\[\]{},;=.:!?#*$%&|]", re.A)


def plain_mentions(text):
    """(start, end, value, patterns) of every mention."""
    ms, out = list(MENTION.finditer(text)), []
    for k, m in enumerate(ms):
        before = text[ms[k - 1].end() if k else 0 : m.start()]
        after = text[m.end() : ms[k + 1].start() if k + 1 < len(ms) else len(text)]
        fold = lambda s: re.sub(r"\s+", " ", s.lower(), flags=re.A)
        one = fold(re.search(r"(?:[^\s\"']+)?[\s\"']*\Z", before, re.A)[0])
        two = re.search(r"[^\s\"']+\s+[^\s\"']+[\s\"']*\Z", before, re.A)
        right = fold(re.match(r"[\"']?[.:!?#*$%&|,;]*\s*(?:[^\s\"']+)?", after, re.A)[0])
        patterns = {fold(two[0]) + "_"} if two else set()
        if one.strip() and right.strip():
            patterns.add(one + "_" + right)
        name = lambda p: hashlib.sha256(p.encode()).hexdigest() if len(p) > 200 else p
        out.append((m.start(), m.end(), m[0].lower(), {name(p) for p in patterns}))
    return out


def bootstrapped(docs):
    """The spans added to each text, by rounds over plain dictionaries until nothing changes."""
    seen = [(i, brute(t), plain_mentions(t or "")) for i, t in docs]
    inside = lambda base, m: any(s < m[1] and m[0] < e for s, _, e, _ in base)
    secret = lambda v: re.fullmatch("[0-9a-f]{32,}", v) is not None
    holds, sure = {}, set()
    for _, base, ms in seen:
        for m in ms:
            for p in m[3]:
                holds.setdefault(p, set()).add(m[2])
            if inside(base, m) or secret(m[2]):
                sure.add(m[2])
    belief, good = {v: 1.0 for v in sure}, None
    while True:
        now = {}
        for p, values in holds.items():
            b = [belief.get(v, 0) for v in values]
            if sum(x >= 0.5 for x in b) >= 3 and sum(b) / (len(b) + 0.5) >= 0.8:
                now[p] = sum(b) / (len(b) + 0.5)
        belief = {v: 1.0 for v in sure}
        for v in set().union(*(holds[p] for p in now)):
            err = np.prod([1 - min(now[p], 0.999) for p in now if v in holds[p]])
            belief[v] = max(belief.get(v, 0), 1 - err)
        if good == set(now):
            break
        good = set(now)
    return [(i, sorted((m[0], m[1]) for m in ms if not inside(base, m) and (secret(m[2]) or belief.get(m[2], 0) >= 0.8))) for i, base, ms in seen]


def test_bootstrapping_equals_brute_force(spark):
    r = random.Random(11)
    # A chain: a context is believed only once the new values of the one before it are.
    stand = lambda c, value: f"text step{c} holder key{c}: {value} then"
    first = [f"first{k}zz" for k in range(24)]
    docs = [stand(0, f"u{k}@mail.org") for k in range(120)] + [stand(0, v) for v in first]
    new = [[f"val{c}x{k}zz" for k in range(5)] for c in range(7)]
    for c in range(1, 7):
        docs += [stand(c, v) for v in [*first, *(new[c - 1] if c > 1 else []), *new[c]]]
    docs += [f"alone {v}" for values in new[1:] for v in values]
    docs += [hashlib.sha1(str(k).encode()).hexdigest() for k in range(3)] + ["line\n" + "ab12" * 10 + "\nline", "ab12" * 10 + " starts"]
    docs += ["w" * 300 + f" holder: first{k}zz after" for k in range(8)] + ["W" * 300 + " holder: new1234 after", "w" * 299 + " holder: new5678 after"]
    docs += [" ".join(r.choices(["mail:", "the", "id1234", "x@y.org", "holder", '"tok99en"', "then", "1.2.3.4"], k=12)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(docs)] + [(None, docs[3]), (1, docs[1]), (900, None)]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    added = sorted([(x["doc_id"], [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == "id"]) for x in got], key=repr)
    want = bootstrapped(rows)
    assert added == sorted(want, key=repr)
    # The chain is followed to its end, and what it teaches is found without a context.
    assert all(v for i, v in want if i is not None and docs[i : i + 1] and docs[i].startswith("alone"))


def test_a_secret_by_itself_is_redacted(spark):
    key = hashlib.sha1(b"x").hexdigest()
    docs = spark.createDataFrame([(1, key), (2, f"line\n{key}\nline"), (3, f"{key} at the start"), (4, "none")], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.redacted(docs).collect()}
    assert got == {1: "[ID]", 2: "line\n[ID]\nline", 3: "[ID] at the start", 4: "none"}


def test_secrets_share_a_context(spark):
    rows = [(k, f'words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" more') for k in range(8)]
    rows.append((50, 'text token = "sk-live-77Qx" end'))
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(any(s["kind"] == "id" for s in r["spans"]) for r in got)


def test_long_tokens_are_taken_whole(spark):
    r = random.Random(6)
    tokens = ["".join(r.choices("abcdefgh-._XYZ", k=n - 2)) + "x7" for n in (6, 255, 256, 257, 1_000, 50_000)]
    rows = [(k, f"note {k} words account holder mail: u{k}@mail.org then more") for k in range(40)]
    rows += [(100 + k, f"other words account holder mail: {t}... then more") for k, t in enumerate(tokens)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == "id"] for x in pii.spans(docs).collect()}
    assert [got[100 + k] for k in range(len(tokens))] == [[(33, 33 + len(t))] for t in tokens]
    clean = {x["doc_id"]: x["text"] for x in pii.redacted(docs).collect()}
    assert {clean[100 + k] for k in range(len(tokens))} == {"other words account holder mail: [ID]... then more"}


def test_mentions_up_to_the_old_length_are_as_before(spark):
    old = r"(?<![^\s\"'<>()\[\]{},;=])(?=[^\s\"'<>()\[\]{},;=@0-9]*+[@0-9])[^\s\"'<>()\[\]{},;=]{5,255}[^\s\"'<>()\[\]{},;=.:!?#*$%&|]"
    r = random.Random(7)
    texts = ["".join(r.choices("ab1@.:!é😀 =\"(", k=r.randrange(60))) for _ in range(3_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    at = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert df.where(~at(old).eqNullSafe(at(pii.MENTION))).count() == 0
    assert df.where(F.size(at(old)) > 0).count() > 1_000


def test_redacted(spark):
    rows = [(1, "mail a@b.c, ip 1.2.3.4!", "s", 9), (2, None, "s", 0), (3, "clean é", "s", 7), (1, "mail a@b.c, ip 1.2.3.4!", "s", 9),
            (None, "x@y.z", "s", 5), (4, "+1 234 567 8901 2345 end 9", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    got = pii.redacted(df, length_col="n_chars")
    assert got.columns == df.columns
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted([
        (1, "mail [EMAIL], ip [IP]!", "s", 22), (2, None, "s", 0), (3, "clean é", "s", 7), (1, "mail [EMAIL], ip [IP]!", "s", 22),
        (None, "[EMAIL]", "s", 7), (4, "[PHONE] end 9", "s", 13)], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans(df).count() == 0 and pii.redacted(df).count() == 0
