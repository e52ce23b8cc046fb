"""Batches of similar length under a token budget.

The lengths of all rows make one histogram. Dynamic programming over it picks the bucket
bounds that need the fewest padding tokens for a given number of buckets; inside a bucket, rows
fill batches whose padded size stays within the budget.

The histogram is exact up to ``EXACT`` tokens; longer lengths are rounded up by at most one part in
``EXACT // 2``, so it has a few thousand bins however long a text is, and only it reaches the driver.

Edge cases: null and empty texts have length 0 and share a bucket with the shortest texts. A row
longer than the budget is a batch of its own. Repeated rows get a place each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BLANK, rank_in_groups, stash

EXACT = 2048


def word_count(text: Column) -> Column:
    """Words between white space: the default length of a text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}|{BLANK}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(BLANK)) + 1).cast("long")


def rounded(length: Column) -> Column:
    """The histogram bin of a length: its largest member."""
    exponent = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)) / EXACT)) + 1, F.lit(0)).cast("int")
    step = F.when(length <= EXACT, F.lit(1)).otherwise(F.pow(F.lit(2.0), exponent)).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    best[k][j] is the least padding of the first j bins in k buckets; a bucket over bins i..j-1
    pads each of its rows to the length of bin j-1. Ties take the lowest bounds.
    """
    n = len(lengths)
    if n == 0:
        return []
    lengths, counts = lengths.astype(np.float64), counts.astype(np.float64)
    rows = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i
        best = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j > 0 and cut[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, budget: int = 16_384, buckets: int = 16, length: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bucket, batch and place of every row.

    ``length`` gives the tokens of a row; words between white space if left out. Returns doc_id,
    n_tokens, bucket (from 0, short to long), bucket_len (what its rows are padded to), batch
    (from 0 in the bucket), place (from 0 in the batch) and batch_tokens (the padded batch's budget share).
    """
    n = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    light = stash(docs.select(F.col(key).alias("doc_id"), n.alias("n_tokens")).withColumn("bin", rounded(F.col("n_tokens"))), "lengths")
    histogram = light.groupBy("bin").count().orderBy("bin").toPandas()
    bounds = optimal_bounds(histogram["bin"].to_numpy(), histogram["count"].to_numpy(), buckets)
    uppers = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(uppers, lambda u: u < F.col("bin")))
    placed = (
        light.withColumn("bucket", bucket)
        .withColumn("bucket_len", F.get(uppers, F.col("bucket")))
        .withColumn("__order", F.xxhash64("doc_id"))
    )
    ranked = rank_in_groups(placed, "bucket", ["__order", "doc_id", "n_tokens"], "__rank")
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("__rank") / rows).cast("long").alias("batch"),
        (F.col("__rank") % rows).cast("int").alias("place"),
        (rows * F.col("bucket_len")).alias("batch_tokens"),
    )
