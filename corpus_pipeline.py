"""The corpus pipeline: documents in, a cleaned and re-weighted training sample out.

Columns of ``documents`` pass through all stages but the last, whatever else the table holds; helper columns have names of
their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, langid, mixing, secrets, simhash, simhash_wide
from weftline.llm.common import discard, read, settle


#: Bytes of an Arrow batch. By rows alone, 10,000 texts are a batch, which both the executor's JVM and its Python workers hold.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 21


def bounded(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most (one row at least) for the session, as stages run after their call; a limit that is set stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no identifiable language go: null and empty texts and those without a letter.

    The language is that of the whole text; repeated rows share their fate, an empty table stays empty.
    """
    bounded(spark)
    return langid.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.

    That is the one with the smallest id (null counts as none); of a group's rows with that id the one with the smallest
    text hash, then the one that comes first as JSON. Null and empty texts are one group, repeated rows another.
    """
    bounded(spark)
    return simhash.keep_one(docs, near=simhash_wide.near_duplicates(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none, nor does an empty benchmark match."""
    bounded(spark)
    return decontam.without_passages(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every row stays, null and empty texts as they are."""
    bounded(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights of sources, languages and topics; adds probability and weight.

    Rows with the same id share their fate. Documents without words are left out; a null source or language is a value.
    """
    bounded(spark)
    return mixing.sample_documents(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("secrets", without_secrets),
    ("mixture", mixed),
]

#: SQL can't express language identification or fingerprints; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again before the next."""
    docs = before = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name)
            discard(before)
            before = docs
    return docs
