"""Text, JSON and media file scans, and the text and JSON sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions import fixed_values as V
from scrubline.functions.json_text import json_text
from scrubline.functions.text import decode_dropping_invalid
from scrubline.plans.clean_text import result_json
from scrubline.plans.glue import glued_pieces, pieces, placed
from scrubline.plans.materialize import stored
from scrubline.plans.names import quoted as _q
from scrubline.plans.skew import join_per_key


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def decode_text(raw: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not UTF-8."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def read_text_files(spark: SparkSession, path, parts: bool = False) -> DataFrame:
    """``(path, text, file_type)``, one row per file; empty files give none.

    A ``.json`` file gives its string leaves; one that does not parse gives its raw
    text without the bytes that are not UTF-8, and the type ``text``. Other files are read
    by ranges of bytes and glued; JSON, and what the line scan would unpack, is read whole.

    A text must fit one cell. With ``parts`` those read by ranges may have any size: the rows
    are ``(path, at, text, file_type)``, and the texts of a file, one after the other by ``at``,
    are its text.
    """
    ending = suffix(F.col("_metadata.file_path"))
    is_json = ending == ".json"
    files = spark.read.format("binaryFile").load(path).where(ending.isin(".json", *V.PACKED_SUFFIXES))
    decoded = files.select("path", "content", is_json.alias("is_json"), decode_text(F.col("content")).alias("raw"))
    parsed = decoded.withColumn("leaves", json_text(F.when(F.col("is_json"), F.col("raw"))))
    whole = parsed.select(
        "path",
        F.when(~F.col("is_json"), F.col("raw"))
        .when(F.col("leaves").isNotNull(), F.col("leaves"))
        .otherwise(decode_dropping_invalid(F.when(F.col("is_json") & F.col("leaves").isNull(), F.col("content"))))
        .alias("text"),
        F.when(F.col("is_json") & F.col("leaves").isNotNull(), "json").otherwise("text").alias("file_type"),
    )
    if parts:
        return _file_parts(spark, path).union(whole.select("path", F.lit(0).cast("long").alias("at"), "text", "file_type"))
    return _glued_files(spark, path).union(whole)


def _named_lines(spark: SparkSession, path) -> DataFrame:
    """``(g, t)``: the lines of the files that are neither JSON nor packed; ``g`` is the size
    and the name of the file."""
    lines = spark.read.option("lineSep", "\n").text(path).where(
        ~suffix(F.col("_metadata.file_path")).isin(".json", *V.PACKED_SUFFIXES))
    name = F.concat_ws("\n", F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_path"))
    return lines.select(name.alias("g"), F.col("value").alias("t"))


def _path_of(g: str) -> Column:
    name = F.split(g, "\n", 2)[1]
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")


def _more() -> Column:
    """Aggregate: bytes of the file beyond its lines and their ends: -1 without a last line
    feed, 3 more for a byte order mark, which the scan leaves out."""
    return F.first(F.split("g", "\n", 2)[0].cast("long")) - F.sum(F.octet_length("t") + F.lit(1).cast("long"))


def _mark(utf8: Column) -> Column:
    return F.when(utf8, F.lit("\ufeff")).otherwise(F.lit("\u00ef\u00bb\u00bf"))


def _glued_files(spark: SparkSession, path) -> DataFrame:
    """``(path, text, file_type)`` of the files that are neither JSON nor packed."""
    glued = glued_pieces(_named_lines(spark, path), "\n")
    ranges = glued.select("g", "at", "t", F.is_valid_utf8("t").alias("utf8"))
    more = _more()
    raw = F.concat_ws("\n", F.concat(pieces(), F.when(more.isin(0, 3), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    text = F.when(F.bool_and("utf8"), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))
    return ranges.groupBy("g").agg(F.when(more < 2, text).otherwise(F.concat(_mark(F.bool_and("utf8")), text)).alias("text")).select(
        _path_of("g").alias("path"), "text", F.lit("text").alias("file_type"))


def _file_parts(spark: SparkSession, path) -> DataFrame:
    """``(path, at, text, file_type)`` of the files that are neither JSON nor packed. A scan of
    the lines finds what holds for a whole file, a second one glues them."""
    lines = _named_lines(spark, path)
    per_file = placed(lines).groupBy("g").agg(
        F.bool_and(F.is_valid_utf8("t")).alias("utf8"), _more().alias("more"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.count(F.lit(1)).alias("n"))
    found = join_per_key(glued_pieces(lines, "\n"), per_file, ["g"], "n", ["at"])
    text = F.when(F.col("utf8"), F.col("t")).otherwise(F.decode(F.col("t").cast("binary"), "ISO-8859-1"))
    before = F.when(F.col("at") > F.col("first"), "\n").when(F.col("more") >= 2, _mark(F.col("utf8"))).otherwise("")
    after = F.when((F.col("to") == F.col("last")) & F.col("more").isin(0, 3), "\n").otherwise("")
    return found.select(_path_of("g").alias("path"), "at", F.concat(before, text, after).alias("text"), F.lit("text").alias("file_type"))


def md5_of_parts(parts: DataFrame) -> DataFrame:
    """``(path, digest, file_type)``: the MD5 of the UTF-8 bytes of every text of
    ``read_text_files(parts=True)``; one task sees the parts of a file in turn and holds a
    batch of them."""
    rows = parts.repartition("path").sortWithinPartitions("path", "at").select(
        "path", F.col("text").cast("binary").alias("text"), "file_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, md5 = None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"path": pa.array(now[:1], pa.string()), "digest": pa.array([md5 and md5.hexdigest()], pa.string()), "file_type": pa.array(now[1:], pa.string())})

        for batch in batches:
            for k, name in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if name != now:
                    if now is not None:
                        yield ended()
                    now, md5 = name, hashlib.md5()
                text = batch.column(1)[k]
                if not text.is_valid:
                    md5 = None
                elif md5 is not None:
                    md5.update(text.as_buffer())
        if now is not None:
            yield ended()

    return rows.mapInArrow(run, "path string, digest string, file_type string")


def _raw_lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("utf8"))


def charsets(spark: SparkSession, path) -> DataFrame:
    """``(path, lines, bad_lines)`` per text file, read by ranges of bytes. A file with lines
    that are not UTF-8 is taken for Latin-1."""
    return _raw_lines(spark, path).groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("utf8")).alias("bad_lines"))


def read_text_lines(spark: SparkSession, path, keep: str = "latin1") -> DataFrame:
    """``(path, at, line)`` for every line of text files of any size.

    A file is read by many tasks; ``at`` grows with the lines of a file and differs for all
    rows. Lines end at line feeds, a carriage return before one goes too. With ``keep``
    ``latin1`` a file that is not UTF-8 throughout is decoded as Latin-1; with ``utf8`` files
    are UTF-8 and lines with other bytes are left to ``read_bad_lines``.
    """
    if keep not in ("latin1", "utf8"):
        raise ValueError("keep must be 'latin1' or 'utf8'")
    rows = _raw_lines(spark, path)
    plain = F.col("raw").cast("string")
    if keep == "utf8":
        text, rows = plain, rows.where("utf8")
    else:
        # Names of files only, which the driver lists for any scan.
        other = [r["path"] for r in charsets(spark, path).where("bad_lines > 0").select("path").collect()]
        text = F.when(F.col("path").isin(other), F.decode("raw", "ISO-8859-1")).otherwise(plain) if other else plain
    return rows.select("path", "at", F.regexp_replace(text, "\r\\z", "").alias("line"))


def read_bad_lines(spark: SparkSession, path) -> DataFrame:
    """``(path, at, raw, repaired)`` of the lines that are not UTF-8: their bytes, and their
    text without those that do not fit."""
    bad = _raw_lines(spark, path).where("not utf8")
    return bad.select("path", "at", "raw", decode_dropping_invalid(F.col("raw")).alias("repaired"))


def text_frame(spark: SparkSession, *texts: str) -> DataFrame:
    """Pasted texts as ``(doc_id, text)``."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the empty files of a folder or glob, which scans leave out by themselves.

    Lists names on the driver, as any scan does.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for match in fs.globStatus(root) or []:
        for status in fs.listStatus(match.getPath()) if match.isDirectory() else [match]:
            if status.isFile() and status.getLen() == 0:
                found.append(status.getPath().toString())
    return found


def read_media(
    spark: SparkSession, path: str, suffixes=V.IMAGE_SUFFIXES, report_empty: bool = True
) -> DataFrame:
    """``(path, length, suffix, sha256, error)`` of the files with a known suffix.

    Files whose leading bytes do not match their suffix, and with ``report_empty``
    empty files, carry an ``error`` and stay in the batch. Contents are hashed and
    dropped, not decoded.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if report_empty:
        names = [(p, 0, bytearray()) for p in empty_files(spark, path)]
        files = files.union(spark.createDataFrame(names, "path string, length long, content binary"))
    files = files.withColumn("suffix", suffix(F.col("path"))).where(F.col("suffix").isin(*suffixes))
    signed = F.lit(False)
    for ending in suffixes:
        for offset, magic in V.MAGIC[ending]:
            head = F.hex(F.substring("content", offset + 1, len(magic) // 2))
            signed = signed | ((F.col("suffix") == ending) & (head == magic))
    error = F.when(F.col("length") == 0, "empty file").when(~signed, "content does not match the suffix")
    return files.select("path", "length", "suffix", F.sha2("content", 256).alias("sha256"), error.alias("error"))


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rejected rows with their message."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def write_text(df: DataFrame, path: str, column: str = "cleaned_text") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def write_result_json(cleaned: DataFrame, path: str, output: str = "cleaned_text") -> None:
    """One JSON object ``{cleaned_text, stats, steps}`` per line."""
    cleaned.select(result_json(cleaned, output).alias("value")).write.text(path)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """One file for each row below ``folder``; gives ``(path, length)``. Names must differ; a
    null content is an empty file. Tasks write through Arrow's file systems, each file at
    once, so a repeated task leaves the same files."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().replace("file:/", "file:///").replace("file://///", "file:///")
    system, root = pafs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            names, data = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            for n, raw in zip(names, data):
                with system.open_output_stream(f"{root}/{n}", compression=None) as out:
                    out.write(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{uri}/{n}" for n in names]), pa.array([len(x) for x in data], pa.int64())], names=["path", "length"])

    rows = df.select(F.col(_q(name)).alias("name"), F.col(_q(content)).alias("content"))
    return stored(rows.mapInArrow(run, "path string, length long"), "files")
