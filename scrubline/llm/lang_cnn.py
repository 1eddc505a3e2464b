"""Language of whole texts by a small byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter keeps its
maximum within a fixed-length window, and a softmax layer turns the maxima into
languages. A text is all its windows: their probabilities are averaged by the bytes they
hold. Trained in numpy on a bounded sample; applied to batches of windows in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import map_batches

#: Bytes of a window; embedding size; filter widths; filters of each width.
WINDOW, EMBEDDED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Documents taken for each language at most; languages taught, those with the most
#: documents; windows of each document; passes. The sample of the fit is bounded by them.
PER_LANGUAGE, MAX_LANGUAGES, WINDOWS_EACH, EPOCHS = 400, 500, 3, 6
#: Windows scored at a time.
BATCH = 128
UNKNOWN = "und"
_WIDEST = max(WIDTHS)
#: A window with the bytes after it that filters at its end can see.
_ROW = WINDOW + _WIDEST - 1
_LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # byte, dimension
    kernel: np.ndarray  # offset * dimension, filter; zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray  # filter, language
    offset: np.ndarray

    def _sliding(self, data: np.ndarray) -> np.ndarray:
        """One row for each window start: the embedded bytes a filter can see."""
        flat = self.embedding[data]
        return np.lib.stride_tricks.as_strided(
            flat, (len(data) - _WIDEST + 1, _WIDEST * EMBEDDED), flat.strides[:1] + flat.strides[1:], writeable=False)

    def maxima(self, rows: np.ndarray) -> np.ndarray:
        """Of each row: a window and the ``_WIDEST - 1`` bytes after it. What a filter sees
        from the start of one row to the next is left out."""
        data = np.append(rows.ravel(), np.zeros(_WIDEST - 1, np.uint8))
        seen = (np.ascontiguousarray(self._sliding(data)) @ self.kernel).reshape(len(rows), _ROW, -1)
        return np.maximum(seen[:, :WINDOW].max(axis=1) + self.bias, 0)

    def chances(self, maxima: np.ndarray) -> np.ndarray:
        z = maxima @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean probability; unknown, 0 for texts without a letter."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        sums = np.zeros((len(texts), len(self.languages)))
        owners: list[int] = []
        weights: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            chances = self.chances(self.maxima(np.concatenate(held))) * np.array(weights)[:, None]
            np.add.at(sums, owners, chances)
            owners.clear(), weights.clear(), held.clear()

        lettered = [bool(t and _LETTER.search(t)) for t in texts]
        for k, text in enumerate(texts):
            if lettered[k]:
                raw = text.lower().encode()
                total = -(-len(raw) // WINDOW)
                padded = np.frombuffer(raw.ljust(total * WINDOW + _WIDEST - 1), np.uint8)
                rows = np.lib.stride_tricks.as_strided(padded, (total, _ROW), (WINDOW, 1), writeable=False)
                for at in range(0, total, BATCH):
                    held.append(rows[at : at + BATCH])
                    n = len(held[-1])
                    owners += [k] * n
                    weights += [min(WINDOW, len(raw) - i * WINDOW) for i in range(at, at + n)]
                    if len(owners) >= BATCH:
                        flush()
        if owners:
            flush()
        for k, row in enumerate(sums):
            if lettered[k]:
                best = int(row.argmax())
                out[k] = (self.languages[best], float(min(1.0, row[best] / row.sum())))
        return out


def fit(windows: list[bytes], languages: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Cross-entropy by Adam over windows of at most ``WINDOW`` bytes, shorter ones padded.
    Every language has the same weight. Without windows the network knows no language."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    seen = np.repeat(np.repeat(np.arange(_WIDEST), EMBEDDED)[:, None], n_filters, axis=1) < np.repeat(WIDTHS, FILTERS)
    params = [
        rng.normal(0, 0.5, (256, EMBEDDED)), rng.normal(0, 0.3, (_WIDEST * EMBEDDED, n_filters)) * seen,
        np.zeros(n_filters), rng.normal(0, 0.2, (n_filters, len(names))), np.zeros(len(names)),
    ]
    params = [p.astype(np.float32) for p in params]
    net = Network(names, *params)
    if len(names) < 1:
        return net
    data = np.frombuffer(b"".join(w[:WINDOW].ljust(_ROW) for w in windows), np.uint8).reshape(-1, _ROW)
    y = np.array([names.index(x) for x in languages])
    mass = (len(y) / (np.bincount(y) * len(names)))[y].astype(np.float32)
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            own = order[at : at + 64]
            b, step = len(own), step + 1
            views = np.lib.stride_tricks.sliding_window_view(data[own], _WIDEST, axis=1)  # text, start, offset
            x = net.embedding[views].reshape(b, WINDOW, -1)
            z = x.reshape(-1, x.shape[2]) @ net.kernel
            z = z.reshape(b, WINDOW, -1)
            where = z.argmax(axis=1)
            top = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0] + net.bias
            feature = np.maximum(top, 0)
            slope = net.chances(feature)
            slope[np.arange(b), y[own]] -= 1
            slope *= mass[own, None] / b
            back = (slope @ net.dense.T) * (top > 0)
            rows = x[np.arange(b)[:, None], where]  # text, filter, offset * dimension
            kernel = np.einsum("bf,bfd->df", back, rows) * seen
            by_byte = (back[:, :, None] * net.kernel.T).reshape(-1, EMBEDDED)
            bytes_seen = views[np.arange(b)[:, None], where].reshape(-1)
            embedding = np.column_stack([np.bincount(bytes_seen, by_byte[:, d], 256) for d in range(EMBEDDED)])
            grads = [embedding, kernel, back.sum(axis=0), feature.T @ slope, slope.sum(axis=0)]
            for p, g, mean, square in zip(params, grads, means, squares):
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                p -= 0.01 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return net


def _windows(text: str, each: int = WINDOWS_EACH) -> list[bytes]:
    """Evenly spread windows of a text, and the short beginnings of the first."""
    raw = text.lower().encode()
    room = max(0, len(raw) - WINDOW)
    starts = sorted({room * k // max(1, each - 1) for k in range(each)})
    whole = [raw[s : s + WINDOW] for s in starts]
    return whole + [whole[0][:n] for n in (12, 32) if len(whole[0]) > n]


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES,
) -> Network:
    """Learn from at most ``per_language`` rows of each language, those with the lowest hash
    of id and text. Rows without language, text or letters teach nothing.

    The languages are counted first; a hash below a language's share thins its rows before
    anything is shuffled. Of more than ``max_languages`` languages those with the most rows
    are taught (ties: the first by name), and no other is ever predicted.
    """
    taught = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    counts = counts.orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return fit([], [])
    parts, scale = 1_000_000, 8
    share = F.create_map(*[F.lit(x) for r in counts for x in (
        r["lang"], min(parts, scale * per_language * parts // r["count"] + 1))])
    few = taught.where(F.pmod("h", F.lit(parts)) < share[F.col("lang")])  # null for other languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_windows(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.binary()))], names=["lang", "h", "windows"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(parts)), "h"))
    cut = map_batches(few, run, "lang string, h long, windows array<binary>").withColumn("rank", rank)
    rows = cut.where(F.col("rank") <= per_language).collect()
    pairs = sorted((r["lang"], r["h"], bytes(w)) for r in rows for w in r["windows"])
    return fit([w for _, _, w in pairs], [x for x, _, _ in pairs])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: the crc32 of the id as text leaves 1 by 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predicted(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for every row of ``docs``, from its text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    the network knows no language. Repeated rows get equal results; an empty table gives an
    empty result; further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=["id", "lang_pred", "score"])

    return map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double"
    ).withColumnRenamed("id", id_col)
