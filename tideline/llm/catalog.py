"""The queries of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, divergence, line_dedup, quality_rules, repeats
from tideline.llm.common import let_workers_import, table
from tideline.llm.html_text import extract
from tideline.llm.langid import held_out, identify, train
from tideline.llm.packing import pack
from tideline.llm.sharding import place
from tideline.llm.neighbours import search
from tideline.llm.oracle import DECONTAMINATE, DIVERGENCE, LINE_DEDUP, QUALITY_RULES
from tideline.llm.simhash import groups, hexadecimal
from tideline.llm.token_counts import token_counts
from tideline.llm.whitening import whiten
from tideline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    model = train(docs.where(~apart), rows_per_language=4000)
    return identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), budget=16_384, buckets=16)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return short.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), length=200)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = {s: 1.0 for s in range(9)}
    return place(table(spark, sf_dir, "documents"), {s: even[s] for s in range(8)}, even)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k").alias("doc_id"), "item_id", "similarity", "first_word")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = scratch_path(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), cache, str(public_tokenizers.path("word_bpe_49k.json")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("failed", F.array_join("failed", ", "))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_simhash,
        op3_language_id,
        op4_packing,
        op5_line_dedup,
        op6_neighbours,
        op7_repeats,
        op8_sharding,
        op9_decontaminate,
        op10_token_counts,
        op11_whitening,
        op12_quality_rules,
        op13_divergence,
    )
}

SQL: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP,
    "op9_decontaminate": DECONTAMINATE,
    "op12_quality_rules": QUALITY_RULES,
    "op13_divergence": DIVERGENCE,
}


def queries() -> dict[str, Query]:
    return {name: _ready(fn) for name, fn in QUERIES.items()}


def _ready(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return fn(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
