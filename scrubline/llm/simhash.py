"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. Every table of the index keeps about half of them, chosen by a
mask: bit ``i`` carries a vector ``m(i)`` of ``radius + 1`` bits, and table ``v`` keeps the
bits with an odd ``<m(i), v>``. The vectors of ``radius`` differing bits span less than the
whole space, so some ``v`` is orthogonal to all of them: in that table the pair has equal
keys. With all ``2 ** (radius + 1) - 1`` tables no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import batch_of, join_hot, map_batches, stored, utf8
from scrubline.llm.components import connected_components

#: Buckets of at most this many fingerprints are compared pair by pair, larger ones by midpoints.
PAIRED = 32
BLOCK_WORDS = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The SimHash of a text over word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    n = len(words) - shingle + 1
    digest, ones = xxhash.xxh64_digest, np.zeros((8, 8), np.int64)
    for at in range(0, n, BLOCK_WORDS):
        block = words[at : min(n, at + BLOCK_WORDS) + shingle - 1]
        joined = b" ".join(block)
        ends = list(accumulate(map(len, block), lambda end, size: end + size + 1))
        starts = [0, *(end + 1 for end in ends)]
        hashes = np.frombuffer(
            b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]), np.uint8
        ).reshape(-1, 8)
        counts = np.bincount((hashes + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
        ones += counts @ _BITS
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8)).tobytes(), "big")


def _marked(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(id, h, fp)`` for rows ``(id, h, text)``; ``fp`` holds the 64 bits as a signed long."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([("id", batch.schema.field(0).type), ("h", pa.int64()), ("fp", pa.int64())])
            bits = np.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(2))], np.uint64)
            yield batch_of(out, batch.column(0), batch.column(1), pa.array(bits.view(np.int64)))

    return map_batches(rows, run, f"id {kind}, h long, fp long")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``(id_col, fp)``; ``fp`` holds the 64 bits as a signed long."""
    return _marked(_hashed(docs, id_col, text_col), shingle, seed).select(F.col("id").alias(id_col), "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """One mask for each table. Every non-zero vector is carried by about as many bits."""
    vectors = (1 << (radius + 1)) - 1
    carried = [i % vectors + 1 for i in range(64)]
    return [
        _signed(sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() & 1)) for v in range(1, vectors + 1)
    ]


def _longs(values) -> F.Column:
    return F.expr("array(" + ", ".join(f"{v}L" if v > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for v in values) + ")")


def _pairs_in(groups: DataFrame, radius: int) -> DataFrame:
    """Pairs within the radius inside small sorted arrays ``fps``."""
    return (
        groups.select("fps", F.posexplode("fps").alias("i", "a"))
        .select("a", F.explode(F.expr(f"filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= {radius})")).alias("b"))
    )


def links(fps: DataFrame, radius: int, paired: int = PAIRED) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints, with the components of the whole
    graph of pairs within ``radius``.

    Buckets of up to ``paired`` fingerprints give their pairs, each compared exactly.
    Fingerprints of a larger bucket are linked without pairs: two of them are within
    ``2h`` bits exactly if some midpoint is within ``h`` bits of both, so each is sent to
    all its midpoints. A midpoint gathers at most as many fingerprints as its ball holds
    (2,081 for h = 2), whatever the number of documents, and its star of links joins them.
    With an odd radius, the members of a midpoint are compared like a small bucket.
    """
    half = (radius + 1) // 2
    keys = fps.select("fp").withColumn("key", F.explode(F.arrays_zip(
        F.expr(f"sequence(0, {2 ** (radius + 1) - 2})").alias("t"),
        F.transform(_longs(covering_masks(radius)), lambda m: m.bitwiseAND(F.col("fp"))).alias("k"),
    ))).select("fp", "key.t", "key.k")
    shared = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes either side for as small as ``fps`` itself, and would broadcast all keys of all tables.
    shared = stored(keys.hint("merge").join(shared, ["t", "k"]), "buckets")
    small = shared.where(f"n <= {paired}").groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    edges = [_pairs_in(small, radius)]

    flips = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    around = shared.where(f"n > {paired}").select("fp").distinct().withColumn("mid", F.explode(F.transform(
        _longs(map(_signed, flips)), lambda m: m.bitwiseXOR(F.col("fp")))))
    balls = around.groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    if radius % 2:
        edges.append(_pairs_in(balls, radius))
    else:
        edges.append(balls.select(F.expr("fps[0]").alias("a"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("b")))
    return reduce(DataFrame.union, edges).distinct()


def _classes(rows: DataFrame, radius: int, paired: int) -> DataFrame:
    """``(fp, copies, root, component_id)``, a written table of the different fingerprints
    of ``rows (id, fp)``; ``root`` names the component."""
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = stored(connected_components(links(nodes, radius, paired)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "named")
    return stored(join_hot(rooted, named, "root", "fps", "fp").select("fp", "copies", "root", "component_id"), "classes")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 42, paired: int = PAIRED,
) -> DataFrame:
    """``(id_col, fp, component_id)``, one row for each row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable over links, the document's own included.
    A null or empty text has fingerprint zero and is linked like any other. Repeated rows
    share a component. A null id never is the smallest one; a component without other ids
    has a null ``component_id``. An empty table gives an empty result. Further columns of
    ``docs`` are not read. A fingerprint or component that holds a large share of the rows
    is split over tasks.
    """
    rows = stored(_marked(_hashed(docs, id_col, text_col), shingle, seed), "fingerprints")
    found = join_hot(rows, _classes(rows, radius, paired), "fp", "copies", "id")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each component: that with its smallest id and, where rows
    of several texts share that id, the lowest hash of its text. A null id comes after all
    others. A row that is repeated in id and text is kept once."""
    rows = stored(_marked(_hashed(docs, id_col, text_col), shingle, 42), "fingerprints")
    found = join_hot(rows, _classes(rows, radius, PAIRED), "fp", "copies", "id")
    each = found.groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")).alias("x")
    chosen = stored(each.groupBy("root").agg(first).select(F.col("x.id").alias("_k_id"), F.col("x.h").alias("_k_h"), F.col("x.n").alias("_k_n")), "chosen")
    kept = docs.join(chosen, F.col(id_col).eqNullSafe(F.col("_k_id")) & (F.xxhash64(text_col) == F.col("_k_h")))
    single = kept.where("_k_n = 1").select(docs.columns)
    if not chosen.where("_k_n > 1").head(1):
        return single
    return single.unionByName(kept.where("_k_n > 1").dropDuplicates(["_k_id", "_k_h"]).select(docs.columns))
