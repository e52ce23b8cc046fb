"""Exponential-smoothing and naive baselines per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.rows import floor_at
from tideline.operators.series import Series
from tideline.operators.splits import tail_split
from tideline.operators.windows import persistence


def ses_baseline(
    df: DataFrame, s: Series, value: str, alphas: Sequence[float], share: float = 0.15, min_rows: int = 12
) -> DataFrame:
    """Hold-out MAE of a flat smoothing forecast and of the previous value, per key.

    The level starts at the first training value; of the given smoothing factors the
    one with the least squared one-step error on the training part is kept.  The
    series must be one row per key and period: its ordered values then fit one array.
    Missing values take the median of the key's training values (0 without any).
    """
    if not s.daily:
        raise ValueError("ses_baseline needs one row per key and period; roll the table up first")
    split = tail_split(df, s, share)
    split = split.withColumn("__v", floor_at(F.col(value).cast("double"), 0.0))
    medians = split.groupBy(*s.keys).agg(F.median(F.when(F.col("split") == "train", F.col("__v"))).alias("__median"))
    split = split.join(medians, list(s.keys)).withColumn("__v", F.coalesce("__v", "__median", F.lit(0.0)))
    split = persistence(split, s, {"__prev": "__v"})
    floor0, prev0 = F.col("__v"), F.col("__prev")
    test = F.col("split") == "test"
    per_key = split.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(test).alias("holdout_n"),
        F.avg(F.when(test, F.abs(floor0 - prev0))).alias("mae_naive"),
        F.array_sort(F.collect_list(F.when(~test, F.struct(F.col(s.time), floor0.alias("v"))))).alias("__train"),
        F.collect_list(F.when(test, floor0)).alias("__test"),
    ).where(F.col("n") >= min_rows)
    values = F.transform("__train", lambda x: x["v"])
    start = F.struct(
        F.element_at(values, 1).alias("level"), F.lit(0.0).alias("sse")
    )

    def step(a):
        return lambda acc, v: F.struct(
            (acc["level"] + a * (v - acc["level"])).alias("level"),
            (acc["sse"] + (v - acc["level"]) * (v - acc["level"])).alias("sse"),
        )

    def finish(a):
        return lambda acc: F.struct(acc["sse"].alias("sse"), F.lit(a).alias("alpha"), acc["level"].alias("level"))

    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    tried = F.array(*[F.aggregate(rest, start, step(F.lit(a)), finish(a)) for a in alphas])
    best = F.array_min(tried)
    return per_key.withColumn("__best", best).select(
        *s.keys,
        "n",
        "holdout_n",
        "mae_naive",
        F.col("__best.alpha").alias("alpha"),
        F.col("__best.level").alias("forecast"),
        (
            F.aggregate("__test", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("__best.level"))) / F.size("__test")
        ).alias("mae_smooth"),
    )
