"""Documents with similar sets of word shingles, by a grouped prefix join.

Shingles have one order: frequent ones last, otherwise by hash. Two sets of the wanted
similarity share ``SHARED`` shingles among the first few of each. Sets with equal size and
equal prefix are one group; prefixes are joined group by group, group pairs are filtered
by size, by place and by what they share, and only then are members compared in full.

A prefix shingle of many groups does not give their pairs. Each of its groups is compared
with a few pivots, and what the links so found do not already connect is compared after.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.chunks import grouped
from scrubline.llm.common import join_hot, map_batches, stored
from scrubline.llm.components import connected_components

#: Shingles two prefixes must share; groups of a shingle compared pair by pair; documents
#: that make a shingle frequent; frequent shingles known to the tasks from each of two counts
#: (4 MB at most). They decide work, not results.
SHARED, PAIRED, FREQUENT, MAX_FREQUENT = 3, 32, 32, 500_000
#: Remembered hashes of words of one worker; tasks for a long list of sets; first wide shingles
#: of a prefix that a place in a list knows, so that pairs are found in the first list they share.
MEMO, SALTS, KNOWN = 150_000, 8, 64
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in _MIX[:2]:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: list[bytes], shingle: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; with fewer words, the whole sequence."""
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mixed((h * np.uint64(_MIX[2])) ^ each[j : j + n])
    return np.unique(h.view(np.int64))


def _first_shingles(n: int, percent: int) -> int:
    """How many shingles of a set of ``n``, lowest hashes first, are kept: a prefix and a half."""
    return min(n, 3 * (n - -(-n * percent // 100) + SHARED) // 2 + 8)


def _hashed(docs: DataFrame, shingle: int, percent: int | None) -> DataFrame:
    """``(id, n, digest, shingles)`` for rows ``(id, text)``: all shingles, or with
    ``percent`` the first few. Without words the digest is null."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for ids, texts in grouped(batch):
                own = [shingle_set(t.encode().lower().split(), shingle, hashes) for t in texts]
                sizes = [len(s) for s in own]
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in own]
                if percent is not None:
                    own = [s[: _first_shingles(len(s), percent)] for s in own]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own))),
                ], names=["id", "n", "digest", "shingles"])

    return map_batches(docs.select("id", "text"), run, f"id {kind}, n long, digest binary, shingles array<long>")


class _Sets(NamedTuple):
    """``rows`` is a written table ``(uid, id, n, digest, shingles)`` with a row for each
    document and its first shingles; all of them are hashed anew from ``docs`` where needed."""

    docs: DataFrame
    rows: DataFrame
    shingle: int
    percent: int

    def whole(self, wanted: DataFrame) -> DataFrame:
        """``(uid, n, shingles)`` with all shingles of the sets ``wanted (uid)``; more than
        once where documents with a set's words also share its id."""
        own = stored(self.rows.select("uid", "id", "digest").join(wanted, "uid", "left_semi"), "wanted")
        ids = own.select(F.col("id").alias("wanted_id")).distinct()
        texts = self.docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
        made = _hashed(texts, self.shingle, None).select("n", "digest", "shingles")
        return made.join(own.select("uid", "digest"), "digest").select("uid", "n", "shingles")


def sets_of(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> _Sets:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _hashed(docs, shingle, percent).withColumn("uid", F.monotonically_increasing_id())
    return _Sets(docs, stored(rows, "sets"), shingle, percent)


def _least_shared(percent: int, a: str, b: str) -> str:
    """SQL: common shingles that sets of sizes ``a`` and ``b`` need at least."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _prefix_size(percent: int) -> str:
    return f"cast(least(n, n - (n * {percent} + 99) div 100 + {SHARED}) as int)"


def _frequent(rows: DataFrame) -> np.ndarray:
    """Hashes of the frequent ones among all ``shingles`` of ``rows``."""
    counts = rows.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    many = stored(counts.where(F.col("k") > FREQUENT), "frequent")
    if many.count() > MAX_FREQUENT:
        many = many.orderBy(F.desc("k"), "token").limit(MAX_FREQUENT)
    return np.sort(many.select("token").toPandas()["token"].to_numpy(np.int64))


def _prefixes(rows: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """``(uid, n, prefix, alike, short)`` for ``rows (uid, n, shingles)``. ``alike`` is equal
    for equal sizes and prefixes; ``short`` tells that more shingles must be looked at."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            if len(last):
                late = last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat
            else:
                late = np.zeros(len(flat), bool)
            own, marks, short = [], [], []
            for n, a, b in zip(batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                size = min(n, n - -(-n * percent // 100) + SHARED)
                tokens, after = flat[a:b], late[a:b]
                prefix = tokens[~after][:size]
                short.append(len(prefix) < size and b - a < n)
                if len(prefix) < size:
                    prefix = np.append(prefix, tokens[after][: size - len(prefix)])
                own.append(prefix)
                marks.append(xxhash.xxh128_digest(prefix.tobytes() + n.to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own))),
                pa.array(marks, pa.binary()), pa.array(short, pa.bool_()),
            ], names=["uid", "n", "prefix", "alike", "short"])

    return map_batches(rows.select("uid", "n", "shingles"), run, "uid long, n long, prefix array<long>, alike binary, short boolean")


def _bucket_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u1, u2)`` of groups that share a shingle of at most ``PAIRED`` groups and
    pass the filters by size, place and number of shared shingles."""
    lists = posts.where(F.col("k") <= PAIRED).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "gid", "pos"))).alias("l"))
    rest = "least({0}.n - {0}.pos, {1}.n - {1}.pos)"
    fits = (
        f"100 * a.n >= {percent} * b.n and least(a.pos, b.pos) + {rest.format('a', 'b')} >= {_least_shared(percent, 'a.n', 'b.n')}"
    )
    pairs = lists.select("l", F.posexplode("l").alias("i", "a")).select(
        "a", F.explode(F.expr(f"filter(slice(l, i + 2, size(l)), b -> {fits})")).alias("b"))
    found = pairs.groupBy(F.col("a.gid").alias("u1"), F.col("b.gid").alias("u2")).agg(
        F.max("a.n").alias("n1"), F.max("b.n").alias("n2"), F.count(F.lit(1)).alias("c"), F.max("a.pos").alias("p1"), F.max("b.pos").alias("p2"))
    # Shingles of more groups may be shared as well.
    wide = posts.where(F.col("k") > PAIRED).groupBy("gid").agg(F.count(F.lit(1)).alias("w"))
    for side in ("1", "2"):
        found = found.join(wide.select(F.col("gid").alias("u" + side), F.col("w").alias("w" + side)), "u" + side, "left")
    need = _least_shared(percent, "n1", "n2")
    return (
        found.withColumn("c", F.expr("c + least(coalesce(w1, 0), coalesce(w2, 0))"))
        .where(f"c >= least({SHARED}, {need}) and c + least(n1 - p1 - 1, n2 - p2 - 1) >= {need}").select("u1", "u2")
    )


def _wide(posts: DataFrame, percent: int) -> DataFrame:
    """Postings of shingles of more than ``PAIRED`` groups; ``r`` counts them within their
    group up to each. Sets that meet at such a shingle and share none of a shorter list have
    at most ``r`` shingles in common up to it, and after it no more than either has left. A
    posting by which its group can be similar to none is left out. ``before`` has what comes
    before a posting of the group's first ``KNOWN`` wide shingles."""
    wide = posts.where(F.col("k") > PAIRED)
    own = Window.partitionBy("gid")
    ranked = wide.withColumn("r", F.row_number().over(own.orderBy("pos"))).withColumn(
        "typical", F.sum("k").over(own) / F.expr(_prefix_size(percent)))
    first = F.sort_array(F.collect_list(F.when(F.col("r") <= KNOWN, F.struct("pos", "token"))).over(own))["token"]
    placed = ranked.withColumn("before", F.slice(first, F.lit(1), F.least(F.col("r") - 1, F.lit(KNOWN))))
    return stored(placed.where(f"r + n - pos - 1 >= (n * {percent} + 99) div 100").select(
        "token", "gid", "n", "pos", "r", "typical", "before"), "wide")


def _alike(percent: int, a: str, b: str, shared: str = "least({a}.r, {b}.r)") -> str:
    """SQL: two sets of a wide list may be similar, by size and by what they can share;
    ``shared`` bounds what they have in common up to this list."""
    return (
        f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {shared.format(a=a, b=b)}"
        f" + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1) >= {_least_shared(percent, a + '.n', b + '.n')}"
    )


def _stars(wide: DataFrame, percent: int) -> DataFrame:
    """Pairs of a pivot ``u1`` and another group of a wide list. One pivot has the most
    widely shared prefix, as the text others were copied from has; another is any."""
    one = F.struct("gid", "n", "pos", "r")
    pivots = stored(wide.groupBy("token").agg(
        F.array_distinct(F.array(F.max_by(one, F.struct("typical", "gid")), F.max_by(one, F.xxhash64("gid")))).alias("pivots"),
        F.count(F.lit(1)).alias("rows")), "pivots")
    pairs = join_hot(wide.select("token", one.alias("x")), pivots, "token", "rows", "x").select("x", F.explode("pivots").alias("p"))
    return pairs.where("p.gid <> x.gid and " + _alike(percent, "p", "x")).select(
        F.col("p.gid").alias("u1"), F.col("x.gid").alias("u2")).distinct()


def _verified(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The pairs ``(u1, u2)`` that are similar, each compared in full; ``u1`` may be hot."""
    own = stored(sets.whole(pairs.select(F.explode(F.array("u1", "u2")).alias("uid")).distinct()), "compared")
    times = stored(pairs.groupBy(F.col("u1").alias("uid")).agg(F.count(F.lit(1)).alias("times")), "times")
    left = own.join(times, "uid").select(F.col("uid").alias("u1"), F.col("n").alias("n1"), F.col("shingles").alias("s1"), "times")
    held = join_hot(pairs, left, "u1", "times", "u2")
    both = held.join(own.select(F.col("uid").alias("u2"), F.col("n").alias("n2"), F.col("shingles").alias("s2")), "u2")
    common = both.select("u1", "u2", "n1", "n2", F.size(F.array_intersect("s1", "s2")).cast("long").alias("i"))
    return stored(common.where(f"100 * i >= {percent} * (n1 + n2 - i)").select(F.col("u1").alias("a"), F.col("u2").alias("b")), "links")


def _open_pairs(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u1, u2)`` inside a list that may be similar and lie in different components.

    ``lists`` has ``(x, y, gid, pos, r, before)``: all sets of the groups under one ``(x, y)``
    are to be compared; ``placed`` has ``(uid, gid, n, root)``. A list within one component is
    dropped before its groups are expanded. Sets that have met in a list known from ``before``
    are not paired again; of others, only shingles not known can be shared up to this one."""
    spans = placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    still = stored(
        lists.join(spans, "gid").groupBy("x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where("lo <> hi").select("x", "y"), "open")
    rows = stored(lists.join(still, ["x", "y"]).join(placed, "gid").select(
        "x", "y", F.struct("uid", "n", "root", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("r", "n").alias("r"), "before").alias("a")).distinct(), "open-rows")
    shared = f"least({{a}}.r, {{b}}.r, 1 + greatest({{a}}.r - {KNOWN + 1}, 0) + greatest({{b}}.r - {KNOWN + 1}, 0))"
    salted = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(a.uid), {SALTS}) as int)"))
    spread = rows.withColumnRenamed("a", "b").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return salted.join(spread, ["x", "y", "salt"]).where(
        "a.uid < b.uid and a.root <> b.root and " + _alike(percent, "a", "b", shared) + " and not arrays_overlap(a.before, b.before)"
    ).select(F.col("a.uid").alias("u1"), F.col("b.uid").alias("u2")).distinct()


def _rooted(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``sets`` with the least ``uid`` reachable over ``edges (a, b)`` as ``root``."""
    roots = stored(connected_components(edges), "roots")
    return sets.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def _links(sets: _Sets, firsts: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between different sets, with the components of all similar pairs.
    ``firsts`` has the rows of ``sets`` for one document of each set."""
    percent, frequent = sets.percent, _frequent(firsts)
    # First shingles hold a whole prefix unless many of them are frequent. Of sets where they
    # are, all shingles are counted as well, so that what is their own comes first.
    short = stored(_prefixes(firsts, frequent, percent).where("short").select("uid"), "short")
    whole = stored(sets.whole(short), "whole")
    frequent = np.union1d(frequent, _frequent(whole))
    made = stored(_prefixes(firsts, frequent, percent), "prefixes")
    late = made.where("short").select("uid").join(short, "uid", "left_anti")
    more = _prefixes(whole.union(sets.whole(late)), frequent, percent).dropDuplicates(["uid"])
    prefixes = made.where("not short").union(stored(more, "prefixes")).drop("short")
    alike = stored(prefixes.groupBy("alike").agg(F.min("uid").alias("gid"), F.count(F.lit(1)).alias("members")).where("members > 1"), "alike")
    members = stored(join_hot(prefixes.select("alike", "uid"), alike, "alike", "members", "uid").select("uid", "gid"), "members")
    leaders = prefixes.join(members.where("uid <> gid"), "uid", "left_anti")
    index = leaders.select(F.col("uid").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = stored(index.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    posts = stored(join_hot(index, shared, "token", "k", "gid"), "posts")

    group_pairs = stored(_bucket_pairs(posts, percent), "pairs")
    wide = _wide(posts, percent)
    stars = _stars(wide, percent).union(members.where("uid <> gid").select(F.col("gid").alias("u1"), F.col("uid").alias("u2")))
    edges = _verified(stored(group_pairs.union(stars).distinct(), "candidates"), sets, percent)

    grouped_sets = prefixes.select("uid", "n").join(members, "uid", "left").withColumn("gid", F.coalesce("gid", "uid"))
    placed = stored(_rooted(grouped_sets, edges), "placed")
    several = members.select("gid").distinct()
    # Pairs of two single sets have been compared.
    unsure = group_pairs.join(several, group_pairs["u1"] == several["gid"], "left_semi").union(
        group_pairs.join(several, group_pairs["u2"] == several["gid"], "left_semi"))
    none, nothing = F.lit(None).cast("int"), F.array().cast("array<bigint>").alias("before")
    lists = (
        several.select(F.col("gid").alias("x"), F.lit(-1).cast("long").alias("y"), "gid", none.alias("pos"), none.alias("r"), nothing)
        .union(unsure.select(F.col("u1").alias("x"), F.col("u2").alias("y"), F.explode(F.array("u1", "u2")), none, none, nothing))
        .union(wide.select("token", F.lit(-2).cast("long"), "gid", "pos", "r", "before"))
    )
    more = stored(_open_pairs(lists, placed, percent), "candidates")
    return edges.union(_verified(more, sets, percent)) if more.head(1) else edges


def similar(
    docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row for each row of ``docs``.

    A document's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased, cut
    at ASCII white space); with fewer words the whole sequence is its only one. Documents
    are linked if ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id reachable over links, the document's own included. Null and empty texts and
    those without words have an empty set and are linked with nothing. Repeated rows share
    a component. A null id never is the smallest one; a component without other ids has a
    null ``component_id``. No documents give no rows; further columns are not read.

    Shingles are compared as 64-bit hashes. Equal sets are compared once, whatever their
    number. Nothing is left out: lists too long for pairs are linked by pivots, and every
    pair that could be similar and is not connected by then is compared.
    """
    sets = sets_of(docs, shingle, percent, id_col, text_col)
    rows = sets.rows.where("n > 0")
    heads = stored(rows.groupBy("digest").agg(
        F.min("uid").alias("uid"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "heads")
    repeated = heads.where("copies > 1").select("digest", "copies", F.col("uid").alias("head"))
    copies = stored(join_hot(rows.select("digest", "uid"), repeated, "digest", "copies", "uid").where("uid <> head").select("uid"), "copies")
    edges = _links(sets, rows.join(copies, "uid", "left_anti"))
    rooted = stored(_rooted(heads, edges), "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")), "named")
    found = stored(join_hot(rooted, named, "root", "sets", "uid").select("digest", "component_id", "copies"), "components")
    joined = join_hot(rows.select("id", "n", "digest", "uid"), found, "digest", "copies", "uid").select("id", "n", "component_id")
    alone = sets.rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return joined.union(alone).toDF(id_col, "n_shingles", "component_id")
