import base64
import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from scrubline.llm import warc


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/1", "<p>x</p>", "n"), (3, "http://a/2", "<p>x</p>", "n"), (9, None, "<p>x</p>", "n"),
    (4, "u\r\nX-Evil: 1", "é" * 1000, "n"), (6, "u", None, "n"), (7, "u", "", "n"), (None, "v", "<p>x</p>", "n"),
    (None, "w", "only null ids", "n"), (None, "w2", "only null ids", "n"), (8, "r", "WARC/1.1\r\n\r\n", "n"),
    (2, "dup", "same row", "n"), (2, "dup", "same row", "n"), (1, "long", "ab " * 200_000, "n"),
]


def expected(rows, min_bytes):
    least = {}
    for i, _, h, *_ in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h, *_ in rows:
        n, first = len((h or "").encode()), least.get(h or "")
        revisit = n >= min_bytes and first is not None and i != first
        out.append((i, n, digest(h), "revisit" if revisit else "response", first if revisit else None))
    return out


def roundtrip(spark, path, rows, min_bytes, split):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n string").repartition(3)
    manifest = warc.write_archives(pages, path, min_bytes=min_bytes, file_bytes=20_000)
    got = warc.read_archives(manifest, split).collect()
    as_id = lambda v: None if v is None else int(v)
    return [(as_id(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], as_id(r["refers_to"])) for r in got]


def test_roundtrip_at_every_split_size(spark, fresh_path):
    r = random.Random(3)
    rows = ROWS + [(100 + k, f"u{k}", r.randbytes(r.randrange(900)).hex(), "n") for k in range(60)]
    for split, least in ((97, 0), (5000, 0), (1 << 20, 9)):
        got = roundtrip(spark, fresh_path(), rows, least, split)
        assert sorted(got, key=repr) == sorted(expected(rows, least), key=repr)


def test_long_urls_come_back(spark, fresh_path):
    r = random.Random(4)
    rows = [(k, f"data:{k}," + r.randbytes(n // 2).hex(), f"<p>{k}</p>") for k, n in enumerate((10, 65_000, 66_000, 200_000, 3_000_000, 10))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, fresh_path(), file_bytes=150_000)
    for split in (5_000, 1 << 20):
        got = warc.read_archives(manifest, split).collect()
        assert len(got) == sum(m["records"] for m in manifest.collect()) == len(rows)
        assert sorted((int(g["page_id"]), g["url"]) for g in got) == [(i, u) for i, u, _ in rows]


def test_ranges_are_read_by_many_tasks(spark, fresh_path):
    rows = [(k, "u", random.Random(k).randbytes(300).hex()) for k in range(200)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), fresh_path(), file_bytes=10_000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    got = warc.read_archives(manifest, 5_000).withColumn("task", F.spark_partition_id())
    assert got.count() == 200 and got.select("task").distinct().count() > 4


def test_text_ids_with_line_ends(spark, fresh_path):
    rows = [("a\r\nX: y", "u", "one"), ("b", "u", "two"), ("c\n", "u", "two")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), fresh_path())
    got = sorted((r["page_id"], r["refers_to"]) for r in warc.read_archives(manifest).collect())
    assert got == [("a%0D%0AX: y", None), ("b", None), ("c%0A", "b")]


def test_one_large_record():
    body = random.Random(1).randbytes(6_000_000)
    data = warc.record(1, "u", body) + warc.record(2, "u", b"next")
    found = list(warc.records_in(io.BytesIO(data), 0, len(data), len(data)))
    assert [len(x.block.partition(b"\r\n\r\n")[2]) for x in found] == [6_000_000, 4]


def test_no_pages(spark, fresh_path):
    assert roundtrip(spark, fresh_path(), [], 0, 100) == []


def test_only_records_that_start_inside_and_no_false_members():
    # A stored (not deflated) member whose payload holds a whole record.
    inner = warc.record(77, "u", b"inner")
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: {len(block)}\r\n\r\n"
    outer = gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=0)
    data = outer + b"noise \x1f\x8b\x08 noise" + warc.record(2, "u", b"second") + warc.record(3, "u", b"third")
    ids = lambda a, b: [x.headers["warc-record-id"] for x in warc.records_in(io.BytesIO(data), a, b, len(data))]
    assert ids(0, len(data)) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    cut = data.index(b"noise")
    assert ids(0, 1) == ["<urn:page:1>"]
    assert ids(cut, len(data)) == ["<urn:page:2>", "<urn:page:3>"]
    assert sorted(ids(cut, len(data) - 5) + ids(len(data) - 5, len(data))) == ["<urn:page:2>", "<urn:page:3>"]


def test_readers_of_the_format_agree():
    data = warc.record(1, "http://x/", b"<p>1</p>")
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"<p>1</p>\r\n\r\n")
    assert warc.parsed(text).headers["warc-payload-digest"] == "sha1:" + digest("<p>1</p>")
    assert warc.parsed(b"HTTP/1.1") is None and warc.parsed(b"WARC/1.1\r\nbad") is None
