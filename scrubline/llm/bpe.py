"""Byte-level BPE in two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a
token with one probe and one comparison. Tier two: other pre-tokens are merged on linked
bytes with a heap of candidate pairs, lowest rank first, leftmost among equals.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.chunks import Remembering, grouped
from scrubline.llm.common import batch_of, map_batches


class PerfectHash:
    """Keys to ``0 .. n - 1`` by hash and displace. Buckets of one key name their slot
    (as ``-1 - slot``), larger ones a displacement under which all their keys fall on free
    slots."""

    PER_BUCKET = 3

    def __init__(self, keys: Sequence[bytes]):
        n = self.n = len(keys)
        self.buckets = n // self.PER_BUCKET + 1
        self.shift = [0] * self.buckets
        members: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in keys:
            bucket, base, step = self._hashes(key)
            members.setdefault(bucket, []).append((base, step, key))
        self.keys: list[bytes | None] = [None] * n
        free = set(range(n))
        for bucket, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                slots = [free.pop()]
                self.shift[bucket] = -1 - slots[0]
            else:
                d = 0
                while True:
                    slots = [(base + d * step) % n for base, step, _ in own]
                    if len(set(slots)) == len(slots) and free.issuperset(slots):
                        break
                    d += 1
                self.shift[bucket] = d
                free.difference_update(slots)
            for slot, (_, _, key) in zip(slots, own):
                self.keys[slot] = key

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 64, h >> 32 & 0xFFFFFFFF | 1

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is not among the keys."""
        if not self.n:
            return -1
        bucket, base, step = self._hashes(key)
        d = self.shift[bucket]
        at = -1 - d if d < 0 else (base + d * step) % self.n
        return at if self.keys[at] == key else -1


class Vocabulary:
    """Tokens with ranks, and the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.table.keys]
        self.tokens = {i: t for t, i in ranks.items()}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}, pattern)

    def ids(self, pre_token: bytes) -> list[int]:
        slot = self.table.slot(pre_token)
        return [self.slot_ids[slot]] if slot >= 0 else merged(pre_token, self.ranks)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "encoder"}

    @cached_property
    def encoder(self) -> Remembering:
        """Ids of texts. A worker keeps it, and the remembered pieces, from task to task."""
        matches = regex.compile(self.pattern).findall

        def encode(piece: str) -> bytes:
            return array("I", [i for m in matches(piece) for i in self.ids(m.encode())]).tobytes()

        return Remembering(encode)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token by merging neighbours, lowest rank first.

    ``end[i]`` is where the part that starts at ``i`` ends, ``before[i]`` where the part
    on its left starts, and ``pair[i]`` the rank of the part joined with the one on its
    right, -1 if there is none. A heap entry packs a rank and a start; it is stale when
    ``pair`` has another rank by now.
    """
    n = len(piece)
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    width = n.bit_length()
    low = (1 << width) - 1
    heap = [r << width | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        start = top & low
        if pair[start] != top >> width:
            continue
        middle = end[start]
        stop = end[start] = end[middle]
        pair[middle] = r = -1
        if stop < n:
            before[stop] = start
            r = get(piece[start : end[stop]], -1)
            if r >= 0:
                push(heap, r << width | start)
        pair[start] = r
        left = before[start]
        if left >= 0:
            pair[left] = r = get(piece[left:stop], -1)
            if r >= 0:
                push(heap, r << width | left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the token ids of every whole text, one row for each row of ``docs``.

    A null or empty text has an empty list. Repeated rows and null ids are kept as they
    are; an empty table gives an empty result; further columns are not read. The vocabulary
    is sent to the executors; its size is that of the vocabulary file.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = shared.value.encoder
        for batch in batches:
            for own, group in grouped(batch):
                coded = to_ids(group)
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(coded), "<u4").view("<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield batch_of(pa.schema([("id", own.type), ("ids", lists.type)]), own, lists)

    return map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>"
    ).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with a binary column: the bytes of its ids. A null list gives null; an id
    outside the vocabulary is an error."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            ids = batch.column(at)
            whole = [
                None if x is None else b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist()))
                if x.is_valid else None
                for x in ids
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(whole, pa.binary())], names=[*batch.schema.names, to]
            )

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in coded.schema)
    return map_batches(coded, run, f"{fields}, `{to}` binary")
