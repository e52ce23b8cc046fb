"""Split-conformal alert sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.quantiles import exact_quantiles


def nonconformity(y: Column, p: Column) -> Column:
    """One minus the probability of the true class."""
    return F.when(y == 1, 1 - p).otherwise(p)


def conformal(cal: DataFrame, test: DataFrame, y: str, p: str, alphas: Sequence[float]) -> DataFrame:
    """Score quantile, alert coverage, specificity and efficiency per error level.

    All levels come from one ranking of the calibration scores and one pass over
    the test rows.  The quantile's share may exceed 1 on few rows; it stops at 1.
    """
    alphas = sorted(alphas)
    scores = cal.where(F.col(y).isNotNull()).select(nonconformity(F.col(y), F.col(p)).alias("__s"))
    n = F.col("n")
    shares = [F.least(F.ceil((n + 1) * F.lit(1 - a)) / n, F.lit(1.0)) for a in alphas]
    slack = 3e-4
    near = sorted({min(max(1 - a + d, 0.0), 1.0) for a in alphas for d in (-slack, slack)})
    qs = exact_quantiles(scores, "__s", shares, names=[f"__q{i}" for i in range(len(alphas))], expect=near)
    # Quantiles fall as the level rises, so the sets are nested: how many of them hold a
    # row says which.  The rows then reduce to one count per number and class.
    levels = qs.select(F.array(*[F.col(f"__q{i}") for i in range(len(alphas))]).alias("__levels"))
    rows = test.where(F.col(y).isNotNull()).join(F.broadcast(levels), how="left")
    held = reduce(add, [(F.col(p) >= 1 - F.get("__levels", F.lit(i))).cast("int") for i in range(len(alphas))])
    cells = rows.groupBy(held.alias("__k")).agg(
        F.count_if(F.col(y) == 1).alias("__pos"),
        F.count_if(F.col(y) == 0).alias("__neg"),
        F.any_value("__levels").alias("__levels"),
    )
    tests = F.collect_list(F.struct("__k", "__pos", "__neg"))  # one entry per number of sets
    whole = cells.agg(
        tests.alias("__cells"),
        F.any_value("__levels").alias("__levels"),
        F.sum("__pos").alias("__p"),
        F.sum("__neg").alias("__n"),
    )
    rows = whole.select("*", F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("__i", "alpha"))

    def inside(field: str) -> Column:
        return F.aggregate(
            "__cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["__k"] > F.col("__i"), c[field]).otherwise(0)
        )

    pos_in, neg_in, pos, neg = inside("__pos"), inside("__neg"), F.col("__p"), F.col("__n")
    return rows.select(
        "alpha",
        F.get("__levels", F.col("__i")).alias("quantile"),
        F.when(pos > 0, pos_in / pos).otherwise(0.0).alias("coverage"),
        F.when(neg > 0, (neg - neg_in) / neg).otherwise(0.0).alias("specificity"),
        (1 - (pos_in + neg_in) / (pos + neg)).alias("efficiency"),
    )
