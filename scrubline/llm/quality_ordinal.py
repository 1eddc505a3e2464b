"""Document quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text; ordered thresholds cut its score:
``P(grade >= k) = sigmoid(score - threshold_k)``. The tails give the expected grade and
the probability of a grade that is good enough.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import map_batches

#: Hashed weights; ratings taken for each grade at most; passes of the fit; weight of the prior.
BUCKETS, PER_GRADE, ROUNDS, RIDGE = 1 << 17, 1_500, 150, 1e-4
#: A bucket is weighted if its share of ratings differs between the lower and the higher
#: grades of some cut by this many standard errors; others would be learned by heart.
SCREEN = 5.0
SHAPE_SCALE = 8.0
MEMO = 200_000
_EDGE = re.compile(r"^\W+|\W+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


REPEAT = _bucket("r")


def places(word: str) -> tuple[int, int]:
    """The buckets of a word and of its shape: letters squeezed to ``a``, or ``A`` if all
    are capitals, digits to ``0``, marks as they are."""
    shape = _LETTERS.sub("A" if len(word) > 1 and word.isupper() else "a", word)
    return _bucket("w" + _EDGE.sub("", word).lower()), _bucket("s" + _DIGITS.sub("0", shape)[:24])


class Places:
    """``places`` with a bounded memory."""

    def __init__(self):
        self._memo: dict[str, tuple[int, int]] = {}

    def __call__(self, word: str) -> tuple[int, int]:
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) > MEMO:
                self._memo.clear()
            found = self._memo[word] = places(word)
        return found


def features(text: str | None, at: Places) -> tuple[list[int], list[float]]:
    """Sparse features: the logarithm of each word's count, the share of each shape, and the
    share of words that repeat the one before."""
    words = (text or "").split()
    counts = Counter(words)
    scale = SHAPE_SCALE / max(1, len(words))
    repeats = sum(map(eq, words, words[1:]))
    index, value = ([REPEAT], [repeats * scale]) if repeats else ([], [])
    for word, n in counts.items():
        w, s = at(word)
        index += (w, s)
        value += (math.log1p(n), n * scale)
    return index, value


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None, at: Places) -> float:
        index, value = features(text, at)
        return float(np.dot(self.weights[index], value)) if index else 0.0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1 .. K, one row for each score."""
        return _sigmoid(np.asarray(scores)[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(
    sizes: np.ndarray, index: np.ndarray, value: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = ROUNDS,
    ridge: float = RIDGE,
) -> Model:
    """Penalised maximum likelihood by Adam over all rows, each grade with equal weight.

    Row ``r`` has the next ``sizes[r]`` of the flat ``index`` (buckets) and ``value``.
    The gaps between thresholds are exponentials, so they stay in order. Without rows all
    grades get equal chances.
    """
    k = n_grades - 1
    even = np.log(np.arange(1, n_grades) / np.arange(k, 0, -1))
    n = len(grades)
    if not n or not k:
        return Model(np.zeros(BUCKETS), even)
    theta = np.concatenate([even[:1], np.log(np.diff(even))])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    known = _telling(owner, index, grades, n_grades)
    place, kept = np.cumsum(known) - 1, known[index]
    owner, index, value = owner[kept], place[index[kept]], value[kept]
    width = int(known.sum())
    weights = np.zeros(width)
    value, y = value.astype(float), grades
    share = np.bincount(y, minlength=n_grades)
    mass = 1 / (share[y] * (share > 0).sum())
    means, squares = [np.zeros(width), np.zeros(k)], [np.zeros(width), np.zeros(k)]
    for t in range(1, rounds + 1):
        cuts = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(owner, value * weights[index], n)
        tail = np.column_stack([np.ones(len(y)), _sigmoid(score[:, None] - cuts), np.zeros(len(y))])
        slope = tail * (1 - tail)
        upper, lower = np.arange(len(y)), y
        chance = np.maximum(tail[upper, lower] - tail[upper, lower + 1], 1e-9)
        by_score = -mass * (slope[upper, lower] - slope[upper, lower + 1]) / chance
        by_cut = np.zeros((len(y), n_grades + 1))
        by_cut[upper, lower] += mass * slope[upper, lower] / chance
        by_cut[upper, lower + 1] -= mass * slope[upper, lower + 1] / chance
        per_cut = by_cut[:, 1:-1].sum(axis=0)
        later = np.cumsum(per_cut[::-1])[::-1]
        grads = [
            np.bincount(index, value * by_score[owner], width) + ridge * weights,
            np.concatenate([[later[0]], later[1:] * np.exp(theta[1:])]),
        ]
        for own, g, mean, square, step in zip((weights, theta), grads, means, squares, (0.05, 0.1)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            own -= step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    whole = np.zeros(BUCKETS)
    whole[known] = weights
    return Model(whole, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]))


def _telling(owner: np.ndarray, index: np.ndarray, grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Buckets that tell grades apart; a row counts once for each of its buckets."""
    met = np.unique(owner.astype(np.int64) * BUCKETS + index)
    rating, bucket = (met // BUCKETS).astype(np.int32), (met % BUCKETS).astype(np.int32)
    everywhere, known = np.bincount(bucket, minlength=BUCKETS), np.zeros(BUCKETS, bool)
    for cut in range(1, n_grades):
        high = grades >= cut
        n_high, n_low = int(high.sum()), int((~high).sum())
        if n_high and n_low:
            above = np.bincount(bucket[high[rating]], minlength=BUCKETS)
            share = everywhere / len(grades)
            error = np.sqrt(np.maximum(share * (1 - share), 1 / len(grades)) * (1 / n_high + 1 / n_low))
            known |= np.abs(above / n_high - (everywhere - above) / n_low) >= SCREEN * error
    return known


def train(
    docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
    grade_col: str = "grade", per_grade: int = PER_GRADE,
) -> Model:
    """Fit on at most ``per_grade`` ratings of each grade, those with the lowest hash of
    their id; a documented bound, whatever the size of the tables.

    Ratings with a null id or grade, or without a document, are passed over; repeated
    ratings count as often as they stand there. Only the ratings are sorted; the sample is
    small and sent to the documents, which are read once and not shuffled.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, n_grades - 1)).select(
        F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade"), F.xxhash64(id_col).alias("_h"))
    # The lowest hashes of each grade by a top-k each, merged before anything is gathered.
    sample = [rated.where(F.col("_grade") == g).orderBy("_h", "_id").limit(per_grade) for g in range(n_grades)]
    chosen = sample[0]
    for more in sample[1:]:
        chosen = chosen.unionAll(more)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").select(F.col("_id").cast("string"), "_grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Places()
        for batch in batches:
            made = [features(t, at) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(0), pa.array([i for i, _ in made], pa.list_(pa.int32())),
                pa.array([v for _, v in made], pa.list_(pa.float32())),
            ], names=["grade", "id", "index", "value"])

    rows = map_batches(found, run, "grade int, id string, index array<int>, value array<float>").toArrow()
    # Flat arrays, in an order of their own, so the same sample always gives the same model.
    rows = rows.combine_chunks().sort_by([("grade", "ascending"), ("id", "ascending")])
    lists = rows["index"].combine_chunks()
    return fit(
        pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), rows["value"].combine_chunks().flatten().to_numpy(),
        rows["grade"].to_numpy(), n_grades)


def _judge(docs: DataFrame, model: Model, min_grade: int, text_col: str, row_of, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, places_of = shared.value, Places()
        for batch in batches:
            tails = m.tails(np.array([m.score(t, places_of) for t in batch.column(at).to_pylist()]))
            yield row_of(batch, tails, tails[:, min_grade - 1])

    return docs.mapInArrow(run, schema)


def judged(
    docs: DataFrame, model: Model, min_grade: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, expected_grade, tail, selected, tails)`` for every row: the mean grade, the
    chance of ``min_grade`` or better, whether that is at least ``least``, and the chances of
    grade 1 or better, 2 or better and so on.

    A null or empty text has no features and score zero, and is judged by the thresholds
    alone. Repeated rows get equal results; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def row_of(batch, tails, tail):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least),
             pa.array(list(tails), pa.list_(pa.float64()))],
            names=["id", "expected_grade", "tail", "selected", "tails"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _judge(slim, model, min_grade, "text", row_of, f"id {kind}, expected_grade double, tail double, selected boolean, tails array<double>"
                  ).withColumnRenamed("id", id_col)


def select(docs: DataFrame, model: Model, min_grade: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``judged`` does not select, all columns kept."""
    return _judge(docs, model, min_grade, text_col, lambda b, _, tail: b.filter(pa.array(tail >= least)), docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings of the ``labels`` table: 0 for low quality, 1 for good but toxic, 2 for good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        F.col("quality") == 1, 2).alias("grade"))
