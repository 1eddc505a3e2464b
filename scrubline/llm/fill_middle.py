"""Fill-in-middle: a text is cut twice and its middle moved to the end, behind marks.

Cuts are made in units (tokens or code points), texts are held as UTF-8. A sparse index
converts between code points and bytes: it holds only the characters of more than one
byte, each with the bytes in excess so far. A bisection finds the exceptions before a cut;
between two of them places differ by a constant, so ASCII stretches are plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import batch_of, map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text worked on at a time (one text at least).
RUN_BYTES = 4 << 20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Exceptions:
    """The characters of more than one byte in a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        self.byte_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte_at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: Excess bytes of all characters before exception k (and of all, at the end).
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        self.char_at = self.byte_at - self.excess[:-1]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before places given in bytes (each between two characters)."""
        return places - self.excess[np.searchsorted(self.byte_at, places)]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before places given in code points."""
        return places + self.excess[np.searchsorted(self.char_at, places)]


def token_ends(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where tokens end in a run of texts: after white space and a word, or a text's end."""
    space = _SPACE[data]
    end = np.zeros(len(data), bool)
    end[:-1] = ~space[:-1] & space[1:]
    end[stops[stops > starts] - 1] = True
    return np.flatnonzero(end) + 1


def _marked(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)])]
    owner = np.searchsorted(stops, at, "right")
    out = np.zeros(len(starts), bool)
    out[owner[at + 3 <= stops[owner]]] = True
    return out


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
        yield at, end
        at = end


def _cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, draws: np.ndarray, unit: str, rate: int, spm: int):
    """Counts, forms and cuts (bytes, and lengths in code points) of a run of texts."""
    index = Exceptions(data)
    if unit == "token":
        ends = token_ends(data, starts, stops)
        first = np.searchsorted(ends, starts, "right")
        n = np.searchsorted(ends, stops, "right") - first
    else:
        first = index.to_chars(starts)
        n = index.to_chars(stops) - first
    cuts = np.sort(draws[:2] % (n + 1), axis=0)
    if unit == "token":
        places = np.concatenate([[0], ends])
        cuts = np.where(cuts > 0, places[first + cuts], starts)
    else:
        cuts = index.to_bytes(first + cuts)
    chars = index.to_chars(np.stack([starts, *cuts]))
    plain = (stops == starts) | _marked(data, starts, stops) | (draws[2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(draws[3] % 100 < spm, "spm", "psm"))
    return n, form, cuts, np.diff(chars, axis=0)


def _draws(seed: int) -> list[Column]:
    """Four numbers of a row: the first 8-digit groups of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(
    docs: DataFrame, unit: str = "token", rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    A text of ``n`` units is cut twice at places drawn from its id, between units. ``unit``
    is ``token`` (white space and the word after it; trailing white space) or ``char`` (a
    code point). ``rate`` of 100 texts are transformed, ``spm`` of 100 of those with the
    suffix first. The form is ``plain`` (output: the text), ``psm`` or ``spm``; a text that
    is empty or holds a mark is plain. Lengths are in code points, null for plain ones.

    A null text is empty; a null id draws as an empty one. Rows of one id draw alike, so
    repeated rows get equal results. No documents give no rows; further columns are not read.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([
                ("id", batch.schema[0].type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                ("middle_chars", pa.int64()), ("output", pa.string())])
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            draws = np.stack([batch.column(2 + k).to_numpy() for k in range(4)])
            for a, b in _runs(offsets):
                data = whole[offsets[a] : offsets[b]]
                starts, stops = offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a]
                n, form, cuts, chars = _cut(data, starts, stops, draws[:, a:b], unit, rate, spm)
                raw, outputs = data.tobytes(), []
                for f, i, x, y, j in zip(form.tolist(), starts.tolist(), *cuts.tolist(), stops.tolist()):
                    if f == "plain":
                        outputs.append(raw[i:j])
                    elif f == "psm":
                        outputs.append(b"".join((p, raw[i:x], s, raw[y:j], m, raw[x:y])))
                    else:
                        outputs.append(b"".join((s, raw[y:j], p, raw[i:x], m, raw[x:y])))
                plain = form == "plain"
                yield batch_of(
                    out, batch.column(0).slice(a, b - a), n, form.tolist(), pa.array(chars[0], mask=plain),
                    pa.array(chars[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()))

    return map_batches(
        rows.select("id", "text", *_draws(seed)), run,
        f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    ).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output. Marks neither overlap themselves nor each other and no
    transformed text holds one, so the three in an output are those that were put there."""
    parts = F.split(output, "<[PSM]>")
    at = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1)))
        .otherwise(output)
    )
