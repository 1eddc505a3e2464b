import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    r = random.Random(3)
    bits = ["a", "é", "日本", "😀", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", " ", " ", "<", ">", "P>", "S", "<S",
            "word", "ß!", "\x1c"]
    docs = [(k, "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5, 40])))) for k in range(600)]
    docs += [(k, t) for k in range(700, 712) for t in ("x <P> y", "<M>", "<S", "   ", " a", "a ", "é")]
    docs += [(None, "a b c"), (None, None), (5, None), (5, "long é " * 60_000), (6, "<P" * 50_000), (2, docs[2][1]), (2, docs[2][1])]
    return docs


@pytest.mark.parametrize("unit,run_bytes", [("token", 4 << 20), ("char", 4 << 20), ("token", 50)])
def test_equals_brute_force_and_restores(spark, unit, run_bytes, monkeypatch):
    docs = rows()
    monkeypatch.setattr(fm, "RUN_BYTES", run_bytes)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    got = fm.transformed(d, unit=unit).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([brute(i, t, unit) for i, t in docs], key=key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["back"]) for r in got) == sorted((i is None, i or 0, t or "") for i, t in docs)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_small_runs_cut_between_texts():
    assert list(fm._runs(np.array([0, 5, 5, 5 + (4 << 20), 10 + (4 << 20)]))) == [(0, 2), (2, 3), (3, 4)]


def test_index_converts_both_ways():
    text = "aé日😀b" * 9 + "xyz"
    index = fm.Exceptions(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in chars])
    assert (index.to_bytes(chars) == places).all() and (index.to_chars(places) == chars).all()
    assert len(index.byte_at) == 27


def test_no_rows_and_unknown_unit(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert fm.transformed(d).count() == 0
    with pytest.raises(ValueError):
        fm.transformed(d, unit="line")
