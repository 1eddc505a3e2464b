"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a bounded run of documents, as word numbers over the words of the benchmark;
all other words are 0. Its suffix array sorts the suffixes by their first words, and every
suffix of every test item is searched in it by bisection, which gives its longest verbatim
match and, for whole windows, all places of the match. Suffixes that meet a word unknown
to the benchmark before the shortest window is full can hold no window, so they are left
out of the array; nothing else is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import map_batches, utf8

#: Words of one shard, and bytes of benchmark text of one block; both bound memory, not results.
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 8 << 20
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class Block:
    """Some test items: their words by number, their suffixes and their windows."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.window = window
        texts = [words_of(t) for _, t in items]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        numbered = [np.array([self.number[w] for w in t], ">u4") for t in texts]
        self.ids = [i for i, _ in items]
        lengths = [min(window, len(t)) for t in texts]
        self.shortest = min((n for n in lengths if n), default=0)
        #: Words to sort by: the longest window.
        self.depth = max(lengths, default=0)
        flat = np.concatenate([*(np.append(t, 0) for t in numbered), np.zeros(self.depth, ">u4")]).astype(">u4")
        starts, sizes, owner, at = [], [], [], 0
        for k, (t, n) in enumerate(zip(numbered, lengths)):
            if n:
                own = np.arange(at, at + len(t))
                starts.append(own)
                # A suffix shorter than the window begins no window (size 0).
                sizes.append(np.where(own + n <= at + len(t), n, 0))
                owner.append(np.full(len(t), k))
            at += len(t) + 1
        if self.shortest:
            # One row for each different suffix (to the depth) and window size, with all items that have it.
            keys, size = _keys(flat, np.concatenate(starts), self.depth), np.concatenate(sizes)
            self.suffixes, row = np.unique(keys, return_inverse=True)
            self.sizes = np.zeros(len(self.suffixes), np.int64)
            self.rows = np.unique(np.stack([row[size > 0], size[size > 0], np.concatenate(owner)[size > 0]]), axis=1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), ">u4", len(words))


def _keys(flat: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words from every start, as byte strings that sort like the words."""
    rows = flat[starts[:, None] + np.arange(depth)] if len(starts) else np.zeros((0, depth), ">u4")
    # Nothing is compared beyond an unknown word or the end.
    rows = np.where(np.minimum.accumulate(rows != 0, axis=1), rows, 0).astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


def _cut(keys: np.ndarray, size: int, depth: int, fill: int) -> np.ndarray:
    """Keys whose words from ``size`` on are the lowest (0) or highest (255) possible."""
    raw = np.zeros((len(keys), 4 * depth), np.uint8)
    raw[:] = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), 4 * depth)
    raw[:, 4 * size :] = fill
    return raw.view(f"S{4 * depth}").ravel()


class SuffixArray:
    """The suffixes of one shard in order, as far as a window of the block can begin there."""

    def __init__(self, flat: np.ndarray, block: Block):
        known = flat != 0
        ends = np.flatnonzero(~known)
        run = ends[np.searchsorted(ends, np.arange(len(flat)))] - np.arange(len(flat))
        places = np.flatnonzero(run >= block.shortest)
        keys = _keys(flat, places, block.depth)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places, self.depth = keys[order], places[order], block.depth

    def places_of(self, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows of ``size`` words the range of the array that begins with each."""
        low = np.searchsorted(self.keys, _cut(windows, size, self.depth, 0), "left")
        high = np.searchsorted(self.keys, _cut(windows, size, self.depth, 255), "right")
        return low, high

    def longest(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix the words of its longest match (to the depth), and a place of it.
        Only one of the two neighbours of the point of insertion can hold it."""
        best, where = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), -1)
        if not len(self.keys) or not len(suffixes):
            return best, where
        at = np.searchsorted(self.keys, suffixes)
        mine = np.ascontiguousarray(suffixes).view(">u4").reshape(len(suffixes), self.depth)
        for side in (at - 1, at):
            ok = (side >= 0) & (side < len(self.keys))
            near = np.clip(side, 0, len(self.keys) - 1)
            other = np.ascontiguousarray(self.keys[near]).view(">u4").reshape(len(suffixes), self.depth)
            same = np.minimum.accumulate((mine == other) & (mine != 0), axis=1).sum(axis=1)
            better = ok & (same > best)
            best[better], where[better] = same[better], self.places[near[better]]
        return best, where


def _hits(shard: list[list[bytes]], block: Block) -> Iterator[tuple[int, int, int, list[int]]]:
    """``(document, first word, end, items)`` of every window found in a shard."""
    if not block.shortest:
        return
    sizes = np.array([len(w) for w in shard])
    flat = np.zeros(int(sizes.sum()) + len(shard) + block.depth, ">u4")
    begins, at = [], 0
    for words in shard:
        flat[at : at + len(words)] = block.numbers(words)
        begins.append(at)
        at += len(words) + 1
    array = SuffixArray(flat, block)
    if not len(array.keys):
        return
    begins = np.array(begins)
    longest, _ = array.longest(block.suffixes)
    rows, widths, owners = block.rows
    for size in np.unique(widths):
        own = (widths == size) & (longest[rows] >= size)
        found, back = np.unique(rows[own], return_inverse=True)
        low, high = array.places_of(block.suffixes[found], int(size))
        items = owners[own]
        order = np.argsort(back, kind="stable")
        first = np.searchsorted(back[order], np.arange(len(found) + 1))
        for k in range(len(found)):
            places = array.places[low[k] : high[k]]
            docs = np.searchsorted(begins, places, "right") - 1
            starts = places - begins[docs]
            mine = items[order[first[k] : first[k + 1]]].tolist()
            for d, s in zip(docs.tolist(), starts.tolist()):
                yield d, s, s + int(size), mine


class Verdict(NamedTuple):
    n_words: int
    spans: list[tuple[int, int]]
    items: list[str]

    @property
    def n_hit(self) -> int:
        return sum(end - start for start, end in self.spans)


def _searcher(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Callable:
    """A function for tasks: UTF-8 texts to their verdicts, shard by shard. The test items
    come in blocks of about ``block_bytes`` bytes (one item at least), so a task holds one
    block at a time however large the benchmark is."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = total // block_bytes + 1
    shared = []
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        shared.append(context.broadcast(
            [("null" if r["i"] is None else r["i"], None if r["t"] is None else r["t"].encode()) for r in rows]))

    def make() -> Callable[[list[bytes | None]], Iterator[Verdict]]:
        one = Block(shared[0].value, window) if n_blocks == 1 else None

        def search(shard: list[list[bytes]]) -> Iterator[Verdict]:
            covers: dict[int, list[tuple[int, int]]] = {}
            named: dict[int, set[str]] = {}
            for part in shared:
                block = one or Block(part.value, window)
                for d, start, end, items in _hits(shard, block):
                    covers.setdefault(d, []).append((start, end))
                    named.setdefault(d, set()).update(block.ids[k] for k in items)
            for d, words in enumerate(shard):
                yield Verdict(len(words), _joined(covers.get(d, [])), sorted(named.get(d, ())))

        def verdicts(texts: list[bytes | None]) -> Iterator[Verdict]:
            shard, size = [], 0
            for text in texts:
                shard.append(words_of(text))
                size += len(shard[-1]) + 1
                if size >= SHARD_WORDS:
                    yield from search(shard)
                    shard, size = [], 0
            yield from search(shard)

        return verdicts

    return make


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id_col, n_words, n_hit, items, spans, contaminated)`` for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A
    word of a document inside any occurrence of a window is hit. ``items`` lists the ids
    (as strings, sorted, each once) of items with an occurring window; ``spans`` the hit
    stretches as word positions ``[start, end)``. A document is contaminated if it has a
    hit and ``share * n_hit >= n_words``. Null and empty texts have no words; items without
    words have no window; a null item id is listed as ``null``; repeated rows get equal
    results; without items nothing is hit, without documents there are no rows. Further
    columns are not read. Documents are neither shuffled nor cut.
    """
    make = _searcher(benchmark, window, item_col, item_text_col, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = make()
        for batch in batches:
            found = list(verdicts(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([v.n_words for v in found], pa.int64()),
                pa.array([v.n_hit for v in found], pa.int64()), pa.array([v.items for v in found], pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in v.spans] for v in found], pa.list_(span)),
                pa.array([_contaminated(v, share) for v in found], pa.bool_()),
            ], names=["id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
        f"id {kind}, n_words bigint, n_hit bigint, items array<string>,"
        " spans array<struct<start: bigint, end: bigint>>, contaminated boolean",
    ).withColumnRenamed("id", id_col)


def _contaminated(v: Verdict, share: int) -> bool:
    return v.n_hit > 0 and share * v.n_hit >= v.n_words


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without its contaminated rows (as in ``matches``), all columns kept."""
    make = _searcher(benchmark, window, item_col, item_text_col, block_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = make()
        for batch in batches:
            keep = [not _contaminated(v, share) for v in verdicts(utf8(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
