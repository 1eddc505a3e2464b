"""Allow and block lists for URLs: a blocked Bloom filter, then an exact hash join.

A rule names a host and a path prefix, and fits the host and its subdomains. The keys a
URL could match are its host's suffixes joined with its path's prefixes of the lengths
that occur in the list. The filter, of bounded size, lets few of them pass; those are
joined with the rules by equality, which removes the false ones. The longest rule wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm.common import hot_keys, join_split, stored

#: Blocks of four 64-bit words; the filter sent to the tasks has at most this many (4 MB).
MAX_BLOCKS, WORDS, BITS_PER_WORD, RULES_PER_BLOCK = 1 << 17, 4, 2, 16
#: Lengths of paths, and of hosts in labels, tried in one pass; a list with more takes more passes.
LENGTHS, LABELS = 1024, 128
SALTS = 32


def rules_of(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A list of (rule, verdict) as ``(rule, verdict)``, for lists written in code."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _listed(rules: DataFrame) -> DataFrame:
    """Canonical rules: host in lower case, path from its first slash; each once. Of two
    rules with the same key the blocking one holds."""
    parts = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        F.translate(F.regexp_extract("rule", "^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("r_path"), "verdict")
    return parts.where("r_host <> ''").groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))


def _filter_key(host: Column, path: Column, blocks: int) -> list[Column]:
    """Block number and one mask for each of its words, from one 64-bit hash."""
    h = F.xxhash64(host, path)
    block = F.pmod(F.shiftrightunsigned(h, 48), F.lit(blocks)) if blocks <= 1 << 16 else F.pmod(F.xxhash64(h), F.lit(blocks))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    masks = [
        reduce(Column.bitwiseOR, [bit(w * BITS_PER_WORD + i) for i in range(BITS_PER_WORD)]) for w in range(WORDS)
    ]
    return [block.alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)]]


def judged(
    urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url",
) -> DataFrame:
    """``urls`` (columns kept) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``(rule, verdict)``; a rule is a host and an optional path prefix such as
    ``example.com/en/``. A row without a fitting rule has a null rule and the ``default``
    verdict. Null rules, rules without a host and unknown verdicts are left out; rules that
    repeat count once. Null URLs and those without ``://`` have empty parts. Repeated rows
    get equal results. Columns of ``urls`` named like a new one are replaced by it.

    Different (host, path) pairs are judged once, and only prefixes and suffixes of lengths
    that occur in the list are looked up, however long a host or path is. A rule that very
    many pairs may fit is split over ``SALTS`` tasks in the exact join, and so are the rows
    of a pair that holds very many of them.
    """
    listed = _listed(rules)
    size = listed.agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("lengths"),
        F.collect_set(_labels(F.col("r_host"))).alias("labels")).first()
    blocks = max(1, min(MAX_BLOCKS, size["n"] // RULES_PER_BLOCK + 1))
    words = [F.bit_or(f"m{w}").alias(f"f{w}") for w in range(WORDS)]
    bloom = listed.select(_filter_key(F.col("r_host"), F.col("r_path"), blocks)).groupBy("block").agg(*words)

    host, path = split_url(F.col("__u"))
    parted = urls.withColumn("__u", F.col(url_col)).withColumns({"host": host, "path": path}).drop("__u")
    pairs = stored(parted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("copies")), "urls")
    tried = [
        _keys(pairs.where("host <> ''"), labels, lengths)
        for labels in _parts(sorted(size["labels"]), LABELS) for lengths in _parts(sorted(size["lengths"]), LENGTHS)
    ]
    probes = reduce(DataFrame.union, tried).select("*", *_filter_key(F.col("r_host"), F.col("r_path"), blocks))
    # The filter has at most MAX_BLOCKS rows, whatever the list holds.
    hits = probes.join(F.broadcast(bloom), "block").where(
        reduce(lambda a, b: a & b, [F.col(f"f{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}") for w in range(WORDS)]))
    salted = hits.select("host", "path", "r_host", "r_path").withColumn("salt", F.expr(f"cast(pmod(xxhash64(host, path), {SALTS}) as int)"))
    spread = listed.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    found = salted.join(spread.hint("shuffle_hash"), ["r_host", "r_path", "salt"])
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = found.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("won"))
    hot = hot_keys(pairs, ["host", "path"], "copies")
    return join_split(parted.drop("rule", "verdict"), best, ["host", "path"], hot, F.spark_partition_id(), SALTS, "left").select(
        *[c for c in parted.columns if c not in ("rule", "verdict", "host", "path")], "host", "path",
        F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _parts(numbers: list[int], size: int) -> list[list[int]]:
    return [numbers[at : at + size] for at in range(0, len(numbers), size)] or [[]]


def _keys(pairs: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """Rule keys a pair could match: its host's last labels with its path's first characters."""
    numbers = lambda values: F.array(*map(F.lit, values)).cast("array<int>")
    suffixes = F.transform(
        F.filter(numbers(labels), lambda k: k <= F.col("n_labels")), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return pairs.select("host", "path", _labels(F.col("host")).alias("n_labels")).select(
        "host", "path", F.explode(suffixes).alias("r_host")).withColumn("r_path", F.explode(prefixes))
