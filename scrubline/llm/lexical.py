"""Ranked lexical search over a length-stratified index.

The index has shards of a bounded run of documents. A shard groups its documents by equal
normaliser ``m`` into strata; a term's postings lie by stratum and, within it, by tf, so an
impact is computed once for each (stratum, tf) and the last tf of a stratum bounds what the
term can add there. A query visits the strata of a shard by falling bound and stops at the
first that cannot reach its ``k`` best so far, which are carried from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import map_batches, stored, utf8
from scrubline.llm.decontam import words_of

#: Bytes of text of a shard and of a row group of shards, terms of a block of queries, strata
#: of the first wave; they bound memory and order work, not results.
SHARD_BYTES, GROUP_BYTES, BLOCK_TERMS, FIRST_WAVE = 4 << 20, 16 << 20, 200_000, 8
#: Fixed values of the score.
SCALE, UNIT, LENGTH_SHARE, SATURATION = 1_000_000_000, 1000, 75, 8


class Index(NamedTuple):
    """``table`` has a row for each shard; documents with a term, and terms of all documents."""

    table: DataFrame
    n_docs: int
    n_terms: int


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _shard(ids: pa.Array, counts: list[np.ndarray], numbers: _Numbers, n_docs: int, n_terms: int) -> dict:
    """The columns of one shard from the term numbers of its documents."""
    size = np.array([len(c) for c in counts], np.int64)
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in size.tolist()], np.int64)
    order = np.argsort(m, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = _runs_of(m[order])
    stratum = np.searchsorted(starts, place, "right") - 1
    flat = np.concatenate(counts)
    key, tf = np.unique(flat * len(size) + np.repeat(place, size), return_counts=True)
    term, doc = key // len(size), key % len(size)
    layer = stratum[order][doc]
    by = np.lexsort((doc, tf, layer, term))
    term, doc, layer, tf = term[by], doc[by], layer[by], tf[by]
    groups = _runs_of(term, layer, tf)
    ints = lambda a: a.astype("<i4").tobytes()
    return {
        "doc_ids": ids.take(pa.array(order)), "m": m[order][starts], "docs": ints(doc), "terms": list(numbers),
        "dfs": np.bincount(term, minlength=len(numbers)),
        "term_groups": ints(np.searchsorted(term[groups], np.arange(len(numbers) + 1))),
        "group_stratum": ints(layer[groups]), "group_tf": ints(tf[groups]),
        "group_start": ints(np.append(groups, len(doc))),
    }


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every row of ``docs``; its shards are a written table.

    Terms are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII, of
    whole texts. Rows without terms (null and empty texts among them) are not found by any
    query. Every row is a document of its own, also where ids or texts repeat. Documents are
    not shuffled; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t)) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

    totals = map_batches(rows.select("text"), counted, "docs long, terms long")
    n_docs, n_terms = (x or 0 for x in totals.agg(F.sum("docs"), F.sum("terms")).first())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, numbers, held = [], [], _Numbers(), 0

        def made(kind: pa.DataType) -> pa.RecordBatch:
            s = _shard(pa.concat_arrays(ids), counts, numbers, n_docs, n_terms)
            listed = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t) if t else a)
            columns = {
                "doc_ids": listed(s.pop("doc_ids"), None), "m": listed(s.pop("m"), pa.int64()),
                "terms": listed(pa.array(s.pop("terms"), pa.binary()).cast(pa.string()), None), "dfs": listed(s.pop("dfs"), pa.int64()),
            } | {c: pa.array([v], pa.binary()) for c, v in s.items()}
            return pa.RecordBatch.from_pydict({c: columns[c] for c in _COLUMNS})

        for batch in batches:
            for k, text in enumerate(utf8(batch.column(1))):
                words = words_of(text)
                if not words:
                    continue
                ids.append(batch.column(0).slice(k, 1))
                counts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                held += len(text)
                if held >= shard_bytes:
                    yield made(batch.schema[0].type)
                    ids, counts, numbers, held = [], [], _Numbers(), 0
        if ids:
            yield made(ids[0].type)

    table = map_batches(rows, run, (
        f"doc_ids array<{kind}>, m array<bigint>, terms array<string>, dfs array<bigint>, docs binary, term_groups binary,"
        " group_stratum binary, group_tf binary, group_start binary"))
    # The writer looks at the size of a row group after a hundred rows only, and a row is a shard.
    return Index(stored(table, "lexical", max(1, GROUP_BYTES // shard_bytes)), n_docs, n_terms)


_COLUMNS = ("doc_ids", "m", "terms", "dfs", "docs", "term_groups", "group_stratum", "group_tf", "group_start")


class _Query(NamedTuple):
    key: int
    terms: np.ndarray  # numbers in the block's list of terms
    weights: np.ndarray  # of the term, times its occurrences in the query


def _spread(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Shard:
    """One shard as far as the terms of a block of queries need it."""

    def __init__(self, row: dict, numbers: dict[bytes, int], n_terms: int):
        self.ids = row["doc_ids"]
        m = np.asarray(row["m"])
        ints = lambda c: np.frombuffer(row[c], "<i4")
        self.docs, groups = ints("docs"), ints("term_groups")
        # Shard terms by their number in the block.
        place = np.full(n_terms, -1)
        for k, t in enumerate(row["terms"]):
            number = numbers.get(t)
            if number is not None:
                place[number] = k
        known = place >= 0
        self.low = np.where(known, groups[place], 0)
        self.high = np.where(known, groups[place + 1], 0)
        self.stratum, tf = ints("group_stratum"), ints("group_tf").astype(np.int64)
        start = ints("group_start")
        self.start, self.stop = start[:-1], start[1:]
        self.impact = SCALE * tf // (UNIT * tf + SATURATION * m[self.stratum])
        # The last tf of a term in a stratum is its highest there.
        last = np.ones(len(tf), bool)
        last[:-1] = self.stratum[1:] != self.stratum[:-1]
        last[groups[1:] - 1] = True
        self.last = last
        self.n_strata = len(m)

    def best(self, q: _Query, k: int, floor: int) -> list[tuple[int, int]]:
        """Up to ``k`` documents and all that tie with the last, of at least ``floor``; as
        (score, place)."""
        low, high = self.low[q.terms], self.high[q.terms]
        own = _spread(low, high)
        if not len(own):
            return []
        weight = np.repeat(q.weights, high - low)
        stratum, gain = self.stratum[own], weight * self.impact[own]
        top = self.last[own]
        bound = np.zeros(self.n_strata, np.int64)
        np.add.at(bound, stratum[top], gain[top])
        visits = np.argsort(-bound, kind="stable")
        scores = np.zeros(len(self.ids), np.int64)
        found_scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, wave = 0, FIRST_WAVE
        while at < self.n_strata:
            chosen = visits[at : at + wave]
            chosen = chosen[bound[chosen] >= max(floor, 1)]
            if not len(chosen):
                break
            due = np.zeros(self.n_strata, bool)
            due[chosen] = True
            mine = np.flatnonzero(due[stratum])
            a, b = self.start[own[mine]], self.stop[own[mine]]
            docs = self.docs[_spread(a, b)]
            np.add.at(scores, docs, np.repeat(gain[mine], b - a))
            seen = np.unique(docs)
            ok = scores[seen] >= max(floor, 1)
            found, found_scores = np.append(found, seen[ok]), np.append(found_scores, scores[seen[ok]])
            if len(found) > k:
                floor = max(floor, int(np.partition(found_scores, -k)[-k]))
                keep = found_scores >= floor
                found, found_scores = found[keep], found_scores[keep]
            at, wave = at + wave, wave * 4
        return list(zip(found_scores.tolist(), found.tolist()))


def _rank(pair: tuple[int, object]):
    score, doc = pair
    return -score, doc is None, doc if doc is not None else 0


def search(
    index: Index, queries: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` best documents of every query, those
    with a score above 0, equal scores by ascending id (null last).

    The score of a document sums ``w * (10^9 tf div (1000 tf + 8 m))`` over the query's terms,
    repeats included; ``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and
    ``m = 25 + (75 n N) div L``. Rows of ``queries`` that are equal in id and text are one
    query; an id with several texts has a ranking for each. Null and empty texts and terms
    that no document holds find nothing; without documents there are no rows.

    Queries come in blocks of about ``block_terms`` terms, one at a time, so neither the
    driver nor a task holds more than a block, whatever their number.
    """
    asked = stored(
        queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
        .withColumn("key", F.monotonically_increasing_id()), "queries")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words, times = np.unique(np.array(words_of(text), object), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(words), pa.int64()), pa.array(list(words), pa.binary()).cast(pa.string()),
                     pa.array(times, pa.int64())], names=["key", "term", "times"])

    wanted = stored(map_batches(asked.select("key", "text"), terms, "key long, term string, times long"), "query-terms")
    held = index.table.select(F.inline(F.arrays_zip("terms", "dfs"))).join(wanted.select("term").distinct(), F.col("terms") == F.col("term"), "left_semi")
    df = held.groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = stored(wanted.join(df, "term").select("key", "term", (F.col("times") * weight).alias("weight")), "weights")
    n_blocks = weighted.count() // block_terms + 1
    found = []
    for b in range(n_blocks):
        mine = weighted.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b).toPandas()
        if len(mine):
            found.append(stored(_searched(index, mine, k), "found"))
    if not found:
        found.append(index.table.select(F.explode("doc_ids").alias("doc")).select(F.lit(0).cast("long").alias("key"), "doc", F.lit(0).cast("long").alias("score")).limit(0))
    by = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item"), "key").select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _searched(index: Index, weighted, k: int) -> DataFrame:
    """``(key, doc, score)``: the ``k`` best of every task for one block of queries."""
    spark = index.table.sparkSession
    listed = sorted(set(weighted["term"]))
    number = {t: i for i, t in enumerate(listed)}
    queries = [
        _Query(int(key), rows["term"].map(number).to_numpy(np.int64), rows["weight"].to_numpy(np.int64))
        for key, rows in weighted.groupby("key")
    ]
    shared = spark.sparkContext.broadcast(([t.encode() for t in listed], queries))
    kind = index.table.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, queries = shared.value
        numbers = {t: i for i, t in enumerate(terms)}
        best: dict[int, list[tuple[int, object]]] = {}
        doc_kind = None
        for batch in batches:
            doc_kind = batch.schema.field("doc_ids").type.value_type
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in _COLUMNS[4:]}
                row["m"] = batch.column("m")[r].values.to_numpy()
                row["doc_ids"] = batch.column("doc_ids")[r].values
                row["terms"] = batch.column("terms")[r].values.cast(pa.binary()).to_pylist()
                shard = _Shard(row, numbers, len(terms))
                for q in queries:
                    now = best.get(q.key, [])
                    new = shard.best(q, k, now[-1][0] if len(now) == k else 0)
                    if new:
                        new = [(score, shard.ids[place].as_py()) for score, place in new]
                        best[q.key] = sorted([*now, *new], key=_rank)[:k]
        if best:
            rows = [(key, doc, score) for key, own in best.items() for score, doc in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], doc_kind), pa.array([x[2] for x in rows], pa.int64())],
                names=["key", "doc", "score"])

    return map_batches(index.table, run, f"key long, doc {kind.simpleString()}, score long")
