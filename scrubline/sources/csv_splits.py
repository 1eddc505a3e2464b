"""CSV whose cells may hold line ends, read by many tasks.

Files are read as raw lines, split anywhere. A line begins inside a quoted cell or not, and
for either case it can be told whether the next one does; so a split is a function on two
states. One scan gives the function of every split, a running composition over the splits
of a file gives the state each begins in, and a second scan cuts the lines into records.
Records that cross the end of a split come as pieces, at most two of a split, and are glued.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSING = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')
_LONE_CR = re.compile(rb"(?<=\r)(?!\n|\Z)")
#: Lines of a split are numbered below this; splits come before them in a row id.
LINES_BITS = 33


def _ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line leaves a quoted cell open. A quote opens a cell only as its first
    character; after the closing one the rest of the cell is plain."""
    at = 0
    if inside:
        closed = _CLOSING.match(line)
        if not closed:
            return True
        at = line.find(b",", closed.end()) + 1
        if not at:
            return False
    while True:
        if line.startswith(b'"', at):
            closed = _CLOSING.match(line, at + 1)
            if not closed:
                return True
            at = line.find(b",", closed.end()) + 1
        else:
            at = line.find(b',"', at) + 1
        if not at:
            return False


def ends_inside(line: bytes, inside: bool) -> bool:
    if b"\r" in line:
        for part in _LONE_CR.split(line):
            inside = _ends_inside(part, inside)
        return inside
    return _ends_inside(line, inside)


def _lines(spark: SparkSession, path) -> DataFrame:
    """Raw lines with their split, without byte order marks."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.when(F.startswith(F.col("value"), F.lit("\ufeff")), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        line.cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of each split in a batch."""
    splits = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((splits[1:] != splits[:-1]) | (files[1:] != files[:-1])) + 1
    bounds = [0, *new.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.column(0)[a].as_py(), int(splits[a]), batch.slice(a, b - a)


def _quoted(lines: pa.Array) -> np.ndarray:
    """Whether each line has a quote; only those can change the state."""
    return pc.greater(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False)


class _Walk:
    """What one scan learns about a split, for both states it may begin in."""

    def __init__(self, file: str, split: int):
        self.file, self.split = file, split
        self.after = [False, True]
        self.utf8, self.n, self.header, self.open = True, 0, [], split == 0

    def add(self, rows: pa.RecordBatch) -> None:
        lines, self.n = rows.column(2), self.n + rows.num_rows
        self.utf8 = self.utf8 and bool(pc.all(rows.column(3)).as_py())
        quoted = _quoted(lines)
        if self.open:
            inside = bool(self.header) and self._header_open
            for k in range(rows.num_rows):
                line = lines[k].as_py()
                if not self.header and not line.strip():
                    continue
                self.header.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    self.open = False
                    break
            self._header_open = inside
        for k in np.flatnonzero(quoted).tolist():
            line = lines[k].as_py()
            one = ends_inside(line, self.after[0])
            self.after = [one, one if self.after[0] == self.after[1] else ends_inside(line, self.after[1])]

    def row(self) -> tuple:
        return self.file, self.split, *self.after, self.utf8, self.n, None if self.open or not self.header else b"\n".join(self.header)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("split", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()), ("utf8", pa.bool_()),
        ("n", pa.int64()), ("header", pa.binary())])
    walk = None
    for batch in batches:
        for file, split, rows in _runs(batch):
            if walk is None or (walk.file, walk.split) != (file, split):
                if walk:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(walk.row(), schema)], schema=schema)
                walk = _Walk(file, split)
            walk.add(rows)
    if walk:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(walk.row(), schema)], schema=schema)


def split_states(spark: SparkSession, path) -> DataFrame:
    """``(file, split, inside, ends_inside, utf8, n, header)``, one row for each split.

    ``inside`` is the state before the split: that left by the last split with one outcome,
    turned by every split since that swaps the states. ``n`` counts lines; ``header`` is the
    first record of a file."""
    found = _lines(spark, path).mapInArrow(_walked, (
        "file string, split long, from_out boolean, from_in boolean, utf8 boolean, n long, header binary"))
    found = found.withColumn("fixed", F.expr("from_out = from_in")).withColumn("swap", F.expr("int(from_out and not from_in)"))
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("turns", F.sum("swap").over(order))
    last = F.last(F.when(F.col("fixed"), F.struct(F.col("from_out").alias("state"), F.col("turns").alias("at"))), True).over(before)
    turns = F.coalesce(F.sum("swap").over(before), F.lit(0))
    found = found.withColumn("last", last).withColumn("since", turns - F.coalesce("last.at", F.lit(0)))
    found = found.withColumn("inside", F.coalesce("last.state", F.lit(False)) != (F.col("since") % 2 == 1))
    return found.select(
        "file", "split", "inside",
        F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("ends_inside"), "utf8", "n", "header")


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header: a name met again gets the first free ``.1``, ``.2`` and so
    on, an empty one is named by its place."""
    cells = [c if c else f"Unnamed: {i}" for i, c in enumerate(cells)]
    taken, out = set(cells), []
    for c in cells:
        name, k = c, 0
        while name in out or (k and name in taken):
            k += 1
            name = f"{c}.{k}"
        out.append(name)
    return out


def cells_of(records: Iterator[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(records)


def parse_header(raw: bytes, utf8: bool) -> list[str]:
    text = raw.decode("utf-8" if utf8 else "latin-1")
    return header_names(next(cells_of(_parts(text)), []))


def _parts(text: str) -> Iterator[str]:
    """A text in lines, line ends kept, as the record reader wants them."""
    return iter(re.split(r"(?<=\n)|(?<=\r)(?!\n)", text + "\n"))


class Files(NamedTuple):
    """What the tasks need to know of the files: one entry for each split and each file, a
    size the driver has at hand anyway to plan a scan."""

    splits: dict[tuple[str, int], tuple[int, bool, bool]]  # number, inside, ends inside
    latin: frozenset[str]
    columns: list[str]
    #: For a file the place of each of its columns among ``columns``.
    places: dict[str, tuple[int, ...]]


def survey(spark: SparkSession, path) -> Files:
    """The states of all splits, the charset and the columns of all files. Columns are
    matched by name; they come in the order in which the files, by path, first name them."""
    rows = sorted(split_states(spark, path).collect(), key=lambda r: (r["file"], r["split"]))
    latin = frozenset(r["file"] for r in rows if not r["utf8"])
    columns: dict[str, int] = {}
    places, known = {}, {}
    for r in rows:
        if r["header"] is None:
            continue
        key = (bytes(r["header"]), r["file"] in latin)
        if key not in known:
            known[key] = tuple(columns.setdefault(name, len(columns)) for name in parse_header(key[0], not key[1]))
        places.setdefault(r["file"], known[key])
    splits = {(r["file"], r["split"]): (k, r["inside"], r["ends_inside"]) for k, r in enumerate(rows)}
    return Files(splits, latin, list(columns), places)


class _Cutter:
    """Cuts the lines of one split into records. What lies open at either end is kept as a
    piece: ``(place, bytes, whether a record begins with it)``."""

    def __init__(self, file: str, split: int, files: Files):
        self.key = (file, split)
        number, self.inside, self.ends = files.splits[self.key]
        #: Pieces come before and after the records of a split, which are numbered from 1.
        self.base, self.n = number << LINES_BITS, 0
        self.begins, self.held = not self.inside, []
        self.crossed, self.header = self.inside or self.ends, split == 0
        self.pieces: list[tuple[int, bytes, bool]] = []

    def add(self, lines: pa.Array) -> Iterator[bytes]:
        for line, quoted in zip(lines.to_pylist(), _quoted(lines).tolist()):
            self.held.append(line)
            if quoted:
                self.inside = ends_inside(line, self.inside)
            if not self.inside:
                whole = b"\n".join(self.held) if len(self.held) > 1 else line
                self.held = []
                if self.begins:
                    yield whole
                else:
                    self.pieces.append((self.base, whole, False))
                    self.begins = True

    def end(self) -> list[tuple[int, bytes, bool]]:
        if self.held:
            self.pieces.append((self.base + (1 << LINES_BITS) - 1 if self.begins else self.base, b"\n".join(self.held), self.begins))
        return self.pieces


_ROWS = pa.schema([("id", pa.int64()), ("cells", pa.list_(pa.string())), ("extra", pa.string())])


def _table(ids: list[int], rows: list, extra: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((ids, rows, extra), _ROWS)], schema=_ROWS)


def _rows_of(raw: bytes, file: str, files: Files) -> Iterator[tuple[list[str | None], str | None]]:
    """Cells in the order of all columns, and the record where it has more cells than its
    header. Blank lines give nothing."""
    if not raw.strip():
        return
    if file not in files.places:
        raise ValueError(f"the header of {file} does not end in its first split")
    text = raw.decode("latin-1" if file in files.latin else "utf-8")
    places, width = files.places[file], len(files.columns)
    for cells in cells_of(_parts(text) if "\n" in text or "\r" in text[:-1] else iter((text,))):
        if cells:
            row: list[str | None] = [None] * width
            for place, cell in zip(places, cells):
                row[place] = cell
            yield row, text if len(cells) > len(places) else None


def read_records(spark: SparkSession, path) -> tuple[DataFrame, list[str]]:
    """``(id, cells, extra)`` of every record of all files, and the columns the cells belong
    to. Cells a record or its file does not have are null; ``extra`` is the record's text if
    it has more cells than its header or a quote is never closed. Ids grow within a file."""
    files = survey(spark, path)
    if not files.columns:
        raise ValueError(f"no header in {path}")
    shared = spark.sparkContext.broadcast(files)
    lines = _lines(spark, path)

    def walk(batches: Iterator[pa.RecordBatch], crossed: bool) -> Iterator[tuple[_Cutter, list[bytes], bool]]:
        cutter = None
        for batch in batches:
            for file, split, rows in _runs(batch):
                if cutter is None or cutter.key != (file, split):
                    if cutter:
                        yield cutter, [], True
                    cutter = _Cutter(file, split, shared.value)
                if cutter.crossed or not crossed:
                    yield cutter, list(cutter.add(rows.column(2))), False
        if cutter:
            yield cutter, [], True

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cutter, records, _ in walk(batches, False):
            ids, rows, extra = [], [], []
            for raw in records:
                for row, more in _rows_of(raw, cutter.key[0], shared.value):
                    if cutter.header:
                        cutter.header = False
                        continue
                    cutter.n += 1
                    ids.append(cutter.base + cutter.n)
                    rows.append(row)
                    extra.append(more)
            if ids:
                yield _table(ids, rows, extra)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cutter, _, done in walk(batches, True):
            if done and cutter.crossed and cutter.end():
                at, parts, begins = zip(*cutter.pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cutter.key[0]] * len(at)), pa.array(at, pa.int64()), pa.array(parts, pa.binary()), pa.array(begins)],
                    names=["file", "id", "part", "begins"])

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(_rows_of(raw, file, shared.value))
                never = raw.decode("latin-1") if ends_inside(raw, False) else None
                if found:
                    yield _table([at] * len(found), [r for r, _ in found], [never or more for _, more in found])

    schema = "id long, cells array<string>, extra string"
    out = lines.mapInArrow(whole, schema)
    if any(inside or ends for _, inside, ends in files.splits.values()):
        parts = lines.mapInArrow(pieces, "file string, id long, part binary, begins boolean")
        parts = parts.withColumn("record", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("id")))
        joined = parts.groupBy("file", "record").agg(
            F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("id", F.col("part").cast("string").alias("part")))).alias("parts"))
        raw = joined.select("file", "id", F.array_join("parts.part", "\n").cast("binary").alias("raw"))
        out = out.union(raw.mapInArrow(glued, schema))
    return out, files.columns
