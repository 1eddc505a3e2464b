import gzip
import io
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.plans import clean_text as plan
from scrubline.plans.parallel import spread
from scrubline.sources import csv, csv_splits, files, names
from scrubline.streaming.incremental import clean_text_stream, text_stream


def write(folder, **contents):
    os.makedirs(folder, exist_ok=True)
    for name, data in contents.items():
        with open(os.path.join(folder, name.replace("__", ".")), "wb") as f:
            f.write(data)
    return folder


def test_types_and_nulls_equal_pandas(spark, fresh_path):
    text = 'i,d,b,s,n,e\n1,1.5,True,"a, ""q""\nb",,x\n2,NA,False,null,,  y \n 3,1e3,true,N/A,,"1d"\n'
    folder = write(fresh_path(), a__csv=text.encode())
    df = csv.read_csv(spark, folder)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "double", "e": "string"}
    p = pd.read_csv(os.path.join(folder, "a.csv"))
    got = df.toPandas()
    for c in ("i", "b", "s", "e"):
        assert [None if pd.isna(x) else x for x in got[c]] == [None if pd.isna(x) else x for x in p[c]]
    assert got["d"].isna().tolist() == p["d"].isna().tolist() and got["n"].isna().all()


def test_na_tokens_equal_pandas():
    from pandas._libs.parsers import STR_NA_VALUES

    assert set(V.NA_TOKENS) == STR_NA_VALUES


def test_encodings_in_one_folder(spark, fresh_path):
    folder = write(fresh_path(), u__csv="n\nzoë\n€\n".encode(), l__csv="n\nzoë\n".encode("latin-1"), b__csv="﻿n\nbom\n".encode())
    df = csv.read_csv(spark, folder)
    assert df.columns == ["n"] and sorted(r["n"] for r in df.collect()) == ["bom", "zoë", "zoë", "€"]


def test_splittable_unless_a_cell_spans_lines(spark, fresh_path):
    folder = write(fresh_path(), a__csv=b'a,b\n"x ""y""",2\n', b__csv=b'a,b\n"x\ny",2\n')
    got = {os.path.basename(r["file"]): r["open_quotes"] for r in csv.scan_files(spark, folder).collect()}
    assert got == {"a.csv": False, "b.csv": True}
    assert csv.read_csv(spark, folder).count() == 2


def test_bad_and_empty_csv(spark, fresh_path):
    folder = write(fresh_path(), a__csv=b'a,b\n1,2\n3\n4,5,6\n7,"x,y"\n')
    with pytest.raises(ValueError):
        csv.read_csv(spark, folder)
    df = csv.read_csv(spark, folder, on_bad_rows="drop", keep_row_id=True)
    assert [(r["a"], r["b"]) for r in df.orderBy("_row_id").collect()] == [(1, "2"), (3, None), (7, "x,y")]
    assert [r["_corrupt"] for r in csv.read_bad_rows(spark, folder).collect()] == ["4,5,6"]
    with pytest.raises(ValueError):
        csv.read_csv(spark, write(fresh_path(), a__csv=b"a,b\n"))


def test_csv_sink(spark, fresh_path):
    df = spark.createDataFrame([(1, ' a "q"', None), (2, "", "x\ny")], "k int, s string, t string")
    path = csv.write_csv(df.coalesce(1), fresh_path())
    assert path.endswith(".csv") and csv.csv_name("X.CSV") == "X.CSV"
    back = csv.read_csv(spark, path)
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(1, ' a "q"', None), (2, None, "x\ny")]


def test_text_and_json_files(spark, fresh_path):
    folder = write(
        fresh_path(), a__txt="grüß".encode(), b__txt="grüß".encode("latin-1"), c__json=b'{"a":"x","l":["y",1]}',
        d__json=b"{bad \xff text", e__txt=b"",
    )
    got = {os.path.basename(r["path"]): (r["text"], r["file_type"]) for r in files.read_text_files(spark, folder).collect()}
    assert got == {
        "a.txt": ("grüß", "text"), "b.txt": ("grüß", "text"), "c.json": ("x\ny", "json"),
        "d.json": ("{bad  text", "text"),
    }


def test_invalid_bytes_are_dropped_but_replacement_characters_stay(spark):
    from scrubline.functions.text import decode_dropping_invalid

    raw = [b"ok \xef\xbf\xbd", b"a\xffb\xc3", "ü".encode(), None]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raw)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(decode_dropping_invalid(F.col("b"))).collect()]
    assert got == [None if r is None else r.decode("utf-8", "ignore") for r in raw]


def test_pasted_text(spark):
    assert [tuple(r) for r in files.text_frame(spark, "a", "b").orderBy("doc_id").collect()] == [(0, "a"), (1, "b")]


def test_media_scan_keeps_rejected_files(spark, fresh_path):
    png = bytes.fromhex("89504E470D0A1A0A") + b"data"
    folder = write(fresh_path(), a__png=png, b__PNG=b"not a png", c__png=b"", d__txt=b"x", e__jpg=bytes.fromhex("FFD8FFE0"))
    media = files.read_media(spark, folder)
    good, bad = files.split_errors(media)
    assert sorted(os.path.basename(r["path"]) for r in good.collect()) == ["a.png", "e.jpg"]
    assert {os.path.basename(r["path"]): r["error"] for r in bad.collect()} == {
        "b.PNG": "content does not match the suffix", "c.png": "empty file",
    }
    wav = write(fresh_path(), a__wav=b"RIFF1234WAVEfmt ", b__mp4=b"1234ftypisom")
    assert files.read_media(spark, wav, V.AUDIO_SUFFIXES + V.VIDEO_SUFFIXES).where("error is null").count() == 2


def test_text_and_json_sinks(spark, fresh_path):
    cleaned = plan.clean_text(spark.createDataFrame([("<b>hi</b> you.",)], "text string"))
    a, b = fresh_path(), fresh_path()
    files.write_text(cleaned, a)
    files.write_result_json(cleaned, b)
    assert spark.read.text(a).first()[0] == "Hi You."
    r = json.loads(spark.read.text(b).first()[0])
    assert r["cleaned_text"] == "Hi You." and r["stats"] == {"chars": 7, "words": 2, "lines": 1, "sentences": 1}
    assert r["steps"][0] == "✓ Stripped HTML tags" and list(r) == ["cleaned_text", "stats", "steps"]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["a.b.png", "x", ".hid", "d/e.jpg"])], "id long, n string")
    out = df.select(names.stem(F.col("n")).alias("s"), names.extension(F.col("n")).alias("e")).collect()
    assert [os.path.splitext(n) for n in ("a.b.png", "x", ".hid", "d/e.jpg")] == [tuple(r) for r in out]
    got = names.sequential_names(df, "id", "100%", "PNG", rows_per_bucket=2).orderBy("id").collect()
    assert [r["filename"] for r in got] == ["100%_001.png", "100%_002.png", "100%_003.png", "100%_004.png"]
    assert df.select(names.processed_name(F.col("n"), ".mp4")).first()[0] == "a.b_processed.mp4"


def unique(spark, given):
    df = spark.createDataFrame(list(enumerate(given)), "id long, n string")
    out = names.unique_names(df, "n", "id", rows_per_bucket=3).orderBy("id").collect()
    return [r["unique_name"] for r in out]


def test_unique_names(spark):
    assert unique(spark, ["a.png"] * 3 + ["b.png"]) == ["a.png", "a_1.png", "a_2.png", "b.png"]
    assert unique(spark, ["a.png", "a.png", "a_1.png"]) == ["a.png", "a_2.png", "a_1.png"]
    assert unique(spark, ["a", "a_2", "a", "a", "a_1", "a", "a_2"]) == ["a", "a_2", "a_3", "a_4", "a_1", "a_5", "a_2_1"]
    many = ["x.t"] * 40 + [f"x_{i}.t" for i in range(0, 60, 3)] + ["x_3.t"] * 5
    got = unique(spark, many)
    assert len(set(got)) == len(many)


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(100, numPartitions=8)
    assert spread(wide, "id") is wide
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == 4


def test_stream_cleans_new_files_once(spark, fresh_path):
    source, target, state = fresh_path(), fresh_path(), fresh_path()
    for i in range(2):
        spark.createDataFrame([(i, f"<b>doc {i}</b>")], "doc_id long, text string").write.mode("append").parquet(source)
        clean_text_stream(text_stream(spark, source), target, state).awaitTermination(120)
    rows = spark.read.parquet(target).orderBy("doc_id").collect()
    assert [r["cleaned_text"] for r in rows] == ["Doc 0", "Doc 1"]


def odd_csv(seed, rows=200):
    """Cells with line ends, quotes inside and outside of quoted cells, blanks, blank lines."""
    r = random.Random(seed)
    bits = ["a", "b,", "é", '""', "\n", "\r\n", ", ", "x y", "'", "1", ""]

    def cell():
        kind = r.random()
        if kind < 0.4:
            return '"' + "".join(r.choices(bits, k=r.randrange(6))) + '"'
        if kind < 0.5:
            return '5" pipe' + r.choice(["", '"', ' "q"'])
        if kind < 0.55:
            return '"x"tail'
        return r.choice(["", "plain", "7", "2.5", "a b", "zoë"])

    lines = [",".join(cell() for _ in range(3)) for _ in range(rows)]
    for k in range(0, rows, 17):
        lines[k] = r.choice(["", "  ", lines[k]])
    return "k,l,m\n" + "\n".join(lines) + "\n"


def as_pandas(text):
    p = pd.read_csv(io.StringIO(text, newline=""), dtype=str, keep_default_na=False)
    return [tuple(x) for x in p.itertuples(index=False)]


@pytest.mark.parametrize("seed,split", [(1, 300), (2, 64), (3, 37), (4, 1 << 20)])
def test_records_over_splits_equal_pandas(spark, fresh_path, seed, split):
    text = odd_csv(seed)
    folder = write(fresh_path(), a__csv=text.encode())
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        if split < 1000:
            assert csv_splits.split_states(spark, folder).count() > 10
        rows, names = csv_splits.read_records(spark, folder)
        got = rows.orderBy("id").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert names == ["k", "l", "m"] and len({r["id"] for r in got}) == len(got)
    want = as_pandas(text)
    assert [tuple(c or "" for c in r["cells"]) for r in got] == [tuple("" if pd.isna(c) else c for c in w) for w in want]
    assert not any(r["extra"] for r in got)


def test_states_of_lines():
    for line, from_out, from_in in [
        (b"a,b", False, True), (b'a,"b', True, False), (b'a","b"', False, False), (b'"a""', True, False), (b'"a"""', False, False),
        (b'5" x', False, False), (b'x"y,"z', True, True), (b'",",', False, True), (b'a\r"b', True, False), (b"", False, True),
    ]:
        assert (csv_splits.ends_inside(line, False), csv_splits.ends_inside(line, True)) == (from_out, from_in), line


def test_headers_are_matched_by_name(spark, fresh_path):
    folder = write(
        fresh_path(), a__csv=b'\xef\xbb\xbfa,b\n1,"x\ny"\n3,z\n', b__csv=b"b,c,a\nq,r,2\n", c__csv="b\nzoë\n".encode("latin-1"))
    df = csv.read_csv(spark, folder)
    assert df.columns == ["a", "b", "c"]
    assert sorted([tuple(r) for r in df.collect()], key=repr) == sorted(
        [(1, "x\ny", None), (3, "z", None), (2, "q", "r"), (None, "zoë", None)], key=repr)


def test_repeated_and_empty_headers_equal_pandas(spark, fresh_path):
    for head in ("a,a,b,a", "a,a.1,a", "x,,y,", "a,a,a.1,a.1"):
        text = head + "\n" + ",".join("1234567"[: head.count(",") + 1]) + "\n"
        folder = write(fresh_path(), a__csv=text.encode())
        want = pd.read_csv(io.StringIO(text))
        for multi_line in (None, True):
            df = csv.read_csv(spark, folder, multi_line=multi_line)
            assert df.columns == list(want.columns) and [tuple(r) for r in df.collect()] == [tuple(want.iloc[0])]


def test_bad_rows_of_split_records(spark, fresh_path):
    folder = write(fresh_path(), a__csv=b'a,b\n1,"x\n"\n3\n4,5,"6\n7"\n8,"never\nclosed,\n')
    with pytest.raises(ValueError):
        csv.read_csv(spark, folder)
    df = csv.read_csv(spark, folder, on_bad_rows="drop", keep_row_id=True)
    assert [(r["a"], r["b"]) for r in df.orderBy("_row_id").collect()] == [(1, "x\n"), (3, None)]
    assert sorted(r["first_cell"] for r in csv.read_bad_rows(spark, folder).collect()) == ["4", "8"]


def test_old_line_ends(spark, fresh_path):
    folder = write(fresh_path(), a__csv=b'a,b\r1,"x\ry"\r2,z\r')
    df = csv.read_csv(spark, folder, multi_line=True, keep_row_id=True).orderBy("_row_id")
    assert [(r["a"], r["b"]) for r in df.collect()] == [(1, "x\ry"), (2, "z")]


def test_lines_of_large_files_are_read_by_many_tasks(spark, fresh_path):
    lines = [f"line {k} é" for k in range(3000)]
    folder = write(fresh_path(), u__txt="\r\n".join(lines).encode(), l__txt=("\n".join(lines) + "\n").encode("latin-1"), e__txt=b"")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = files.read_text_lines(spark, folder)
        assert df.rdd.getNumPartitions() > 8
        got = df.orderBy("at").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    for name in ("u.txt", "l.txt"):
        assert [r["line"] for r in got if r["path"].endswith(name)] == lines
    seen = {os.path.basename(r["path"]): (r["lines"], r["bad_lines"]) for r in files.charsets(spark, folder).collect()}
    assert seen == {"u.txt": (3000, 0), "l.txt": (3000, 3000)}


def test_lines_with_bad_bytes_are_set_aside(spark, fresh_path):
    folder = write(fresh_path(), a__txt=b"one\n\xfftwo\xc3\nthr\xc3\xa9e\n")
    assert [r["line"] for r in files.read_text_lines(spark, folder, keep="utf8").orderBy("at").collect()] == ["one", "thrée"]
    bad = files.read_bad_lines(spark, folder).collect()
    assert [(bytes(r["raw"]), r["repaired"]) for r in bad] == [(b"\xfftwo\xc3", "two")]
    with pytest.raises(ValueError):
        files.read_text_lines(spark, folder, keep="other")


def test_large_text_files_are_glued_from_ranges(spark, fresh_path):
    lines = "".join(f"line {k} é\r\n" for k in range(2000))
    packed = gzip.compress(b"x")
    want = {
        "u.txt": (lines + "end").encode(), "n.txt": (lines + "\n\n").encode(), "l.txt": lines.encode("latin-1"), "o.txt": b"\n",
        "b.txt": b"\xef\xbb\xbfmark\n", "c.txt": b"\xef\xbb\xbf\xe9", "a+b %41 é.txt": b"x\0y", "p.gz": packed, "e.txt": b""}
    folder = fresh_path()
    os.makedirs(folder)
    for name, raw in want.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(raw)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "2000")
        df = files.read_text_files(spark, folder)
        assert df.columns == ["path", "text", "file_type"]
        got = {r["path"]: (r["text"], r["file_type"]) for r in df.collect()}
        names = {r["path"] for r in spark.read.format("binaryFile").load(folder).select("path").collect()}
        pieces = files.glued_pieces(spark.read.text(folder).select(F.col("_metadata.file_name").alias("g"), F.col("value").alias("t")), "\n")
        assert pieces.where("g = 'u.txt'").count() > 8
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

    def text(raw):
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    assert {os.path.basename(p): t for p, t in got.items()} == {n: (text(raw), "text") for n, raw in want.items() if raw}
    assert set(got) == names


def test_text_lines_writes_a_language_by_many_tasks(spark, fresh_path, monkeypatch):
    from scrubline.catalog import QUERIES
    from scrubline.catalog import files as catalog

    root, made = fresh_path(), fresh_path()
    rows = [(k, ["en", "fr", None][k % 3], None if k % 10 == 9 else f"a{k % 4}\nb") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4).write.parquet(f"{root}/documents.parquet")
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: f"{made}/{name}")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "2000")
        got = {(r["lang"], r["line"]): r["n"] for r in QUERIES["text_lines"](spark, root).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {}
    for k, lang, t in rows:
        if t:
            for line in (t + (" é" if lang == "en" else " €")).split("\n"):
                key = (lang or "__HIVE_DEFAULT_PARTITION__", line)
                want[key] = want.get(key, 0) + 1
    assert got == want
    assert len([x for x in os.listdir(f"{made}/latin/lang=en") if x.startswith("part-")]) > 1


def test_text_files_in_parts_give_the_same_texts(spark, fresh_path, monkeypatch):
    import hashlib

    from scrubline.plans import glue

    monkeypatch.setattr(glue, "PIECE_BYTES", 500)
    lines = "".join(f"line {k} é\r\n" for k in range(1000))
    folder = write(
        fresh_path(), u__txt=(lines + "end").encode(), n__txt=(lines + "\n\n").encode(), l__txt=lines.encode("latin-1"), o__txt=b"\n",
        b__txt=b"\xef\xbb\xbfmark\n" + lines.encode(), c__txt=b"\xef\xbb\xbf\xe9", e__txt=b"", p__gz=gzip.compress(b"x"),
        j__json=b'{"a":"x","l":["y",1]}', k__json=b"{bad \xff text", m__json=b"1")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in held:
            spark.conf.set(k, "2000")
        whole = {r["path"]: (r["text"], r["file_type"]) for r in files.read_text_files(spark, folder).collect()}
        parts = files.read_text_files(spark, folder, parts=True)
        assert parts.columns == ["path", "at", "text", "file_type"]
        rows = parts.orderBy("path", "at").collect()
        digests = [tuple(r) for r in files.md5_of_parts(parts).collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        text, _ = got.get(r["path"], ("", None))
        got[r["path"]] = (None if r["text"] is None else text + r["text"], r["file_type"])
    assert got == whole and len(whole) == 10
    most = max(len(r["text"].encode()) for r in rows if r["text"])
    assert most < 800 and len([r for r in rows if r["path"].endswith("/u.txt")]) > 20
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert sorted(digests) == sorted((p, md5(t), kind) for p, (t, kind) in whole.items())
