"""A training corpus from raw documents: rate, deduplicate, decontaminate, redact, encode.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and gives
what it keeps, with the columns of ``documents``; the last one gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrubline.catalog.registry import table
from scrubline.llm import bpe, decontam, pii, quality_ordinal, simhash
from scrubline.llm.common import stored
from scrubline.llm.queries import CLEAN_GRADE, byte_vocabulary, quality_model


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely rated good and not toxic than toxic or low."""
    return quality_ordinal.select(docs, quality_model(spark, docs, sf_dir), min_grade=CLEAN_GRADE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a telling share of benchmark passages."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. ``n_chars`` follows the text."""
    return pii.redacted(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids)``: token ids of every remaining document."""
    return bpe.encode(docs, byte_vocabulary())


STAGES = [
    ("quality classifier", rate),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("pii", redact),
    ("byte-level bpe", encode),
]

#: No SQL for hashed regression, fingerprints or token ids; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
