"""Cutting a text where no token of a byte-level vocabulary can cross.

Every match of the split pattern takes a space only as its first character or as part of
a run of white space. A single space between two other characters therefore always begins
a match, and a text may be cut in front of it. The pieces repeat often, so their ids are
worth remembering, while the texts are still encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered pieces of one worker (twice as many at most), what a piece costs
#: beside its characters, and the longest of them; they bound memory, not results.
MEMO_BYTES, ENTRY_BYTES, MEMO_CHARS = 64 << 20, 200, 40
MARKS = ".,;:!?"
_RUN = re.compile(r"\s\s")
_SINGLE = re.compile(r" (?=\S)(?<=\S )")


def pieces(text: str) -> list[str]:
    """The pieces of ``text``; all but the first have lost their leading space."""
    if text[:1] == " " or text[-1:] == " " or _RUN.search(text):
        return _SINGLE.split(text)
    return text.split(" ")


class _Memo(dict):
    """Ids by piece, made when a piece is first asked for. Pieces are kept in two
    generations; the older one is dropped when the younger is full."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self._make, self._limit, self._old, self._room = make, limit, {}, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._make(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
            self._room -= ENTRY_BYTES
        return ids

    def trim(self) -> None:
        if self._room < 0:
            self._old, self._room = dict(self), self._limit
            self.clear()


class Remembering:
    """Ids of texts as bytes (32 bits each) by an encoder of one piece."""

    def __init__(self, encode: Callable[[str], bytes], memo_bytes: int = MEMO_BYTES):
        self._encode = encode
        self._memo = _Memo(self._fresh, memo_bytes)
        self._marks = {m: encode(m) for m in MARKS}

    def _fresh(self, piece: str) -> bytes:
        """Between a letter and a mark after it every match ends, so ``word,`` is ``word``
        and ``,``."""
        if piece[-1:] in self._marks and piece[:-1].isalpha():
            return self._memo[piece[:-1]] + self._marks[piece[-1]]
        return self._encode(" " + piece)

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        known, out = self._memo.__getitem__, []
        for text in texts:
            cut = pieces(text)
            first = cut.pop(0)
            out.append(self._encode(first) + b"".join(map(known, cut)))
            self._memo.trim()
        return out


def grouped(batch: pa.RecordBatch, chars: int = 400_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """The rows of a batch of ids and texts in runs of about ``chars`` characters, so that a
    call works on a bounded amount. Null texts are empty."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right"))
        run = batch.slice(at, max(1, end - at))
        yield run.column(0), [t or "" for t in run.column(1).to_pylist()]
        at += run.num_rows
