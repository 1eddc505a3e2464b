"""Token ids as directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id,
level 1 the second chunk of those ids that have one, and so on. A bitmap beside each level
says which ids go on; a directory holds the number of set bits before every 512th, so the
place of an id in the next level is one lookup and one short count. Any id is read by at
most one step per level, without decoding a block.

A store is a folder of two tables: ``segments`` with the codes of consecutive documents
(``part, seg, doc_ids, doc_ends, n_tokens, codes``) and ``directory`` with the position of
every segment in the whole sequence (``part, seg, start, n_tokens, n_docs``). Tables are
written by Spark's own committers, so lost executors and repeated tasks leave no partial
or double segment.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.llm.chunks import Remembering, grouped
from scrubline.llm.common import map_batches

MAGIC = b"DAC1"
RANK_BITS = 512
#: A segment is closed by the document that takes it over this many ids.
SEGMENT_TOKENS = 1 << 20


def pack(ids: np.ndarray) -> bytes:
    """The codes of ``ids`` (unsigned, below 2 ** 32)."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<I", len(levels))]
    for chunk, more in levels:
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        per_block = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        if not more.any():
            bits, ranks = bits[:0], ranks[:0]
        out += [struct.pack("<QQQ", len(chunk), len(bits), len(ranks)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Reading packed codes: any single id, any range, or all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a code segment")
        (n,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(n):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            parts = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4"))):
                parts.append(np.frombuffer(data, kind, size, at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ids of ``level`` before ``i`` that go on."""
        _, bits, ranks = self.levels[level]
        if not len(ranks):
            return 0
        block = i // RANK_BITS
        own = bits[block * RANK_BITS // 8 : i // 8]
        last = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(own).sum()) + last.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * level
            if not len(bits) or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: on every level they are one range too."""
        found = []
        for level, (chunk, bits, _) in enumerate(self.levels):
            more = (
                np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
                if len(bits) else np.zeros(stop - start, bool)
            )
            found.append((chunk[start:stop].astype(np.uint32), more))
            if not more.any():
                break
            start, stop = self._rank(level, start), self._rank(level, stop)
        value = found.pop()[0]
        for chunk, more in reversed(found):
            chunk[more] |= value << 8
            value = chunk
        return value


#: The characters the library's byte-level models have for the 256 bytes.
#: Visible Latin-1 characters stand for themselves, the other bytes for those from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - _VISIBLE))}
#: Pre-tokens of visible characters below this, spaces and line feeds are cut here; what
#: else there is the library cuts itself.
_PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-\u024f]*")
#: Bytes of remembered pieces of one worker.
MEMO_BYTES, MEMO_CUTS = 96 << 20, 50_000


@lru_cache(maxsize=1)
def library_encoder(path: str, literal: bool = True, pattern: str = public_tokenizers.PATTERN) -> Remembering:
    """Ids by the tokenizers library from a byte-level tokenizer file, no special tokens
    added. Where a text itself has the string of a special token, that is plain text if
    ``literal``, else the token, as by the library's default. (Such a token must have no
    space and strip none, or cutting at single spaces would change ids.)

    A piece of plain characters is cut by the file's own ``pattern`` and goes to the
    library's model at once; all others, and those with a special token, take the library's
    whole way. A worker keeps its encoder, and with it the remembered pieces, from task to
    task. The library runs on the task's own core: its threads would compete with the other
    tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = literal
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, specials)) or "(?!)").search
    # What is remembered here is remembered before the library's own small store is asked.
    model = tokenizer.model
    model._resize_cache(0)
    tokenize, matches, plain = model.tokenize, regex.compile(pattern).findall, _PLAIN.fullmatch
    cuts: dict[str, bytes] = {}

    space, words = BYTE_CHARS[ord(" ")], not any(t.isalpha() for t in specials)

    def one(cut: str) -> bytes:
        chars = cut.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in tokenize(chars)]).tobytes()

    def encode(piece: str) -> bytes:
        if words and piece[:1] == " " and piece[1:].isalpha():
            if piece.isascii():
                return array("I", [t.id for t in tokenize(space + piece[1:])]).tobytes()
            if plain(piece):
                return one(piece)
        if not plain(piece) or special(piece):
            return array("I", tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        out = []
        for cut in matches(piece):
            ids = cuts.get(cut)
            if ids is None:
                ids = one(cut)
                if len(cuts) < MEMO_CUTS:
                    cuts[cut] = ids
            out.append(ids)
        return b"".join(out)

    return Remembering(encode, MEMO_BYTES)


def _spec(spark_type: str) -> str:
    return f"part int, seg int, doc_ids array<{spark_type}>, doc_ends array<bigint>, n_tokens bigint, codes binary"


def write_tokens(
    docs: DataFrame, folder: str, make_encoder: Callable[[], Callable[[Sequence[str]], Sequence[bytes]]],
    end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every whole text and write a store to ``folder``, in ascending id order.

    ``make_encoder`` is called in each task and gives the ids of texts as bytes. ``end_id``
    is appended to every document (None: nothing). A null or empty text has only the end
    id. Null ids come first; rows with equal ids come in the order of a hash of their
    texts. An empty table gives a store without segments. A document is never cut, so a
    segment holds at most ``segment_tokens`` ids and one document more. The texts are
    shuffled once, by range of id.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, encode = TaskContext.get().partitionId(), 0, make_encoder()
        ids: list = []
        ends: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(parts), "<u4"))
            id_type = schema.field("doc_ids").type
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([ids], id_type),
                pa.array([ends], pa.list_(pa.int64())), pa.array([ends[-1]], pa.int64()), pa.array([codes], pa.binary()),
            ], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(batch.schema.field(0).type)),
                    ("doc_ends", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("codes", pa.binary()),
                ])
            for own, group in grouped(batch):
                for i, coded in zip(own.to_pylist(), encode(group)):
                    parts.append(coded + tail)
                    ends.append((ends[-1] if ends else 0) + len(parts[-1]) // 4)
                    ids.append(i)
                    if ends[-1] >= segment_tokens:
                        yield close()
                        ids, ends, parts, seg = [], [], [], seg + 1
        if ids:
            yield close()

    (
        map_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, _spec(kind))
        .write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{folder}/segments")
    )
    written = spark.read.parquet(f"{folder}/segments").select("part", "seg", "n_tokens", F.size("doc_ids").alias("n_docs"))
    # One row for each task that wrote, so the running sum over tasks is small; within a task it runs by segment.
    tasks = written.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    tasks = tasks.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_tokens")
    (
        written.withColumn("inside", inside).join(tasks, "part")
        .select("part", "seg", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "n_docs")
        .write.parquet(f"{folder}/directory")
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a store, from its files."""
    segments = spark.read.parquet(f"{folder}/segments")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seg, ids, ends, data = (batch.column(c)[i] for c in range(5))
                codes, at = Codes(data.as_py()), 0
                whole = codes.slice(0, len(codes)).astype("<u4")
                ends = ends.values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seg.as_py(), np.int32)), ids.values,
                    pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64()),
                ], names=["part", "seg", "doc_id", "offset", "n_tokens", "ids_crc32"])

    docs = map_batches(
        segments.select("part", "seg", "doc_ids", "doc_ends", "codes"), run,
        f"part int, seg int, doc_id {kind}, offset bigint, n_tokens bigint, ids_crc32 bigint",
    )
    starts = spark.read.parquet(f"{folder}/directory").select("part", "seg", "start")
    return docs.join(starts, ["part", "seg"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, folder: str, position: int) -> int:
    """The id at a position of the whole sequence: one directory row, one segment, one code."""
    place = spark.read.parquet(f"{folder}/directory").where(
        (F.col("start") <= position) & (F.col("start") + F.col("n_tokens") > position)).first()
    if place is None:
        raise IndexError(position)
    segment = spark.read.parquet(f"{folder}/segments").where(
        (F.col("part") == place["part"]) & (F.col("seg") == place["seg"])).select("codes").first()
    return Codes(bytes(segment["codes"]))[position - place["start"]]
