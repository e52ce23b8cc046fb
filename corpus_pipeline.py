"""A training corpus from raw documents: five stages, each written before the next reads it.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and gives a table. All but the
last keep the columns of documents, and what a stage decides holds for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, langid, line_dedup, simhash
from tideline.llm.common import let_workers_import, stash, table
from tideline.llm.packing import pack

#: Texts whose best language is less probable than this are rejected, like those without a letter.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang becomes what the text is in. Null texts and texts without letters go.

    The model learns from the labelled rows of the documents table, not from those that are held out.
    """
    let_workers_import(spark)
    labelled = table(spark, sf_dir, "documents")
    model = langid.train(labelled.where(~langid.held_out(F.col("doc_id"))), rows_per_language=4000)
    kept = langid.annotate(docs, model).where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return _as_documents(kept.withColumn("lang", F.col("__lang")), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier; n_chars follows the text."""
    short = line_dedup.deduplicate(docs)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _as_documents(short, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    let_workers_import(spark)
    return _as_documents(simhash.deduplicate(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _as_documents(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each document."""
    return pack(docs, budget=16_384, buckets=16)


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no SimHash or language model; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, name)
    return docs
