"""Token counts through a digest cache.

The cache is a Parquet table of (version, digest, n_tokens). The digest is the SHA-256 of the
normalised text, the version that of the tokenizer file, so a changed tokenizer never meets old
counts. Only digests that the cache lacks are encoded, once each, and appended; every text
then gets its count by a join on the digest. A run that is cut short leaves a cache that the next
run completes; counts appended twice are equal and count once.

Edge cases: a null text counts as empty and has 0 tokens. Equal texts and texts that differ only in
the width of white space share an entry. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stash, utf8_length

CACHE_SCHEMA = "version string, digest string, n_tokens long"
#: Words that one Python worker remembers the length of at a time.
REMEMBERED = 200_000
#: Texts that are split into words, and words that are encoded, at once.
AT_ONCE, ENCODED_AT_ONCE = 64, 4096


def normalised(text: Column) -> Column:
    """White space narrowed to one space and trimmed; the tokenizer drops white space anyway."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))


def counter(tokenizer: Broadcast[str]):
    """A function over Arrow batches (digest, body) to (digest, n_tokens).

    The tokenizer splits at white space before anything else, so a text has as many
    tokens as its words together, and each distinct word is encoded once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(tokenizer.value)
        library.no_truncation()
        library.no_padding()
        known: dict[str, int] = {"": 0}
        for batch in batches:
            totals = []
            bodies = batch.column("body")
            for start in range(0, len(bodies), AT_ONCE):
                split = [t.split(" ") for t in bodies.slice(start, AT_ONCE).to_pylist()]
                wanted = set().union(*split)
                if len(known) + len(wanted) > REMEMBERED:
                    known = {"": 0}
                new = [w for w in wanted if w not in known]
                for some in range(0, len(new), ENCODED_AT_ONCE):
                    part = new[some : some + ENCODED_AT_ONCE]
                    known.update(zip(part, map(len, library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                totals += [sum(map(known.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(totals, pa.int64())], names=["digest", "n_tokens"]
            )

    return count


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty if nothing was appended yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame, cache: str, tokenizer_file: str, limit: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; appends to the cache at ``cache``."""
    spark = docs.sparkSession
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    version = hashlib.sha256(definition.encode()).hexdigest()
    body = normalised(F.col(text))
    rows = docs.select(
        F.col(key).alias("doc_id"), utf8_length(F.col(text)).alias("n_bytes"), F.sha2(body, 256).alias("digest")
    )
    light = stash(rows, "digests")
    stored = read_cache(spark, cache).where(F.col("version") == version)
    missing = light.join(stored, "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("first"))
    texts = docs.select(F.col(key).alias("doc_id"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    same = (F.col("m.digest") == F.col("t.digest")) & F.col("m.first").eqNullSafe(F.col("t.doc_id"))
    misses = texts.alias("t").join(missing.alias("m"), same, "left_semi").select("digest", "body")
    encoded = misses.mapInArrow(counter(spark.sparkContext.broadcast(definition)), "digest string, n_tokens long")
    (
        encoded.groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .select(F.lit(version).alias("version"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache)
    )
    counts = (
        read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return light.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
