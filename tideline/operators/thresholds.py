"""Threshold sweeps and searches on score histograms.

Rows are binned once by the thresholds they reach; every grid point is then a sum
over at most (thresholds + 1) cells, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stages import clamp
from tideline.operators.evaluation import _f1, _macro_f1, _ratio


def grid_points(lo: float, step: float, n: int) -> list[float]:
    """lo, lo + step, ..., the doubles both sides of a comparison must share."""
    return [lo + i * step for i in range(n)]


def reached(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds a score reaches (0..len(grid))."""
    return reduce(add, [F.coalesce(score >= F.lit(t), F.lit(False)).cast("int") for t in grid])


def threshold_sweep(
    df: DataFrame, y: str, score: str, grid: Sequence[float], w_fp: float = 1.0, w_fn: float = 3.0, by: Sequence[str] = ()
) -> DataFrame:
    """TP/TN/FP/FN, precision, recall, F1 and weighted cost per threshold."""
    cells = (
        df.where(F.col(y).isNotNull())
        .groupBy(*by, reached(F.col(score), grid).alias("__k"))
        .agg(F.count_if(F.col(y) == 1).alias("__pos"), F.count_if(F.col(y) == 0).alias("__neg"))
    )
    above = lambda c, i: F.sum(F.when(F.col("__k") > i, F.col(c)).otherwise(0))
    points = [
        F.struct(
            F.lit(t).alias("threshold"),
            above("__pos", i).alias("tp"),
            above("__neg", i).alias("fp"),
            (F.sum("__pos") - above("__pos", i)).alias("fn"),
            (F.sum("__neg") - above("__neg", i)).alias("tn"),
        )
        for i, t in enumerate(grid)
    ]
    rows = cells.groupBy(*by).agg(F.array(*points).alias("a")).select(*by, F.explode("a").alias("r")).select(*by, "r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(
        *by,
        "threshold",
        "tp",
        "tn",
        "fp",
        "fn",
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        _f1(tp, tp + fn, tp + fp).alias("f1"),
        (fp * F.lit(w_fp) + fn * F.lit(w_fn)).alias("cost"),
    )


def best_threshold(sweep: DataFrame, min_recall: float) -> DataFrame:
    """Cheapest threshold with enough recall; the cheapest of all if none has it."""
    short = F.when(F.bround("recall", 3) >= min_recall, 0).otherwise(1)
    return sweep.agg(F.min_by(F.struct(*sweep.columns), F.struct(short, "cost", "threshold")).alias("b")).select("b.*")


def apply_thresholds(p_caution: Column, p_top: Column, t_top: Column | float, t_caution: Column | float) -> Column:
    """2 if the top probability reaches its threshold, else 1 if the other one does."""
    return F.when(p_top >= t_top, 2).when(p_caution >= t_caution, 1).otherwise(0)


def threshold_grid(
    df: DataFrame,
    y: str,
    p_caution: str,
    p_top: str,
    top_grid: Sequence[float],
    caution_grid: Sequence[float],
    w_fp: float = 1.0,
    w_fn: float = 3.0,
) -> DataFrame:
    """Metrics for every pair of thresholds from a joint histogram.

    The histogram has (|top| + 1) x (|caution| + 1) x 3 cells; two running sums over
    it give, for each pair, how many rows of each class get each decision. Classes above
    2 count as 2, below 0 as 0; rows without a class are left out.
    """
    labels = [0, 1, 2]
    cells = (
        df.where(F.col(y).isNotNull())
        .withColumn(y, clamp(F.col(y), 0, 2))
        .groupBy(
            reached(F.col(p_top), top_grid).alias("__b"),
            reached(F.col(p_caution), caution_grid).alias("__c"),
        )
        .agg(*[F.count_if(F.col(y) == c).alias(f"__h{c}") for c in labels])
    )
    nb, nc = len(top_grid), len(caution_grid)
    dense = (
        df.sparkSession.range(nb + 1)
        .select(F.col("id").cast("int").alias("__b"))
        .withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(nc))))
        .join(cells, ["__b", "__c"], "left")
        .na.fill(0, [f"__h{c}" for c in labels])
    )
    # Rows reaching at most i top thresholds, per caution bin ...
    upto_b = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    first = dense.withColumns({f"__u{c}": F.sum(f"__h{c}").over(upto_b) for c in labels})
    # ... and of those, the rows reaching more than j caution thresholds.
    from_c = Window.partitionBy("__b").orderBy(F.col("__c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_c = Window.partitionBy("__b")
    sums = first.withColumns(
        {f"__one{c}": F.coalesce(F.sum(f"__u{c}").over(from_c), F.lit(0)) for c in labels}
        | {f"__below{c}": F.sum(f"__u{c}").over(all_c) for c in labels}
    )
    totals = cells.agg(*[F.coalesce(F.sum(f"__h{c}"), F.lit(0)).alias(f"__all{c}") for c in labels])
    grid = sums.where((F.col("__b") < nb) & (F.col("__c") < nc)).join(F.broadcast(totals), how="left")
    d = {}  # decisions: d[truth, decision]
    for c in labels:
        d[c, 2] = F.col(f"__all{c}") - F.col(f"__below{c}")
        d[c, 1] = F.col(f"__one{c}")
        d[c, 0] = F.col(f"__below{c}") - F.col(f"__one{c}")
    total = reduce(add, [F.col(f"__all{c}") for c in labels])
    macro = [(d[c, c], F.col(f"__all{c}"), reduce(add, [d[t, c] for t in labels])) for c in labels]
    fp = d[0, 1] + d[0, 2]
    fn = d[1, 0] + d[2, 0]
    pick = lambda g, i: F.element_at(F.array(*[F.lit(t) for t in g]), F.col(i) + 1)
    return grid.select(
        F.col("__b").alias("i_top"),
        F.col("__c").alias("i_caution"),
        pick(top_grid, "__b").alias("t_top"),
        pick(caution_grid, "__c").alias("t_caution"),
        ((d[0, 0] + d[1, 1] + d[2, 2]) / total).alias("accuracy"),
        _macro_f1(macro).alias("macro_f1"),
        fp.alias("fp"),
        fn.alias("fn"),
        (fp * F.lit(w_fp) + fn * F.lit(w_fn)).alias("cost"),
        F.bround(d[2, 2] / F.greatest(F.col("__all2"), F.lit(1)), 3).alias("top_recall"),
    )


def search_thresholds(grid: DataFrame, min_top_recall: float = 0.70) -> DataFrame:
    """Best pair by macro-F1, by cost, and by cost with enough top recall.

    The first pair in grid order wins a tie; without any pair of enough recall the
    last choice falls back to plain cost.
    """
    place = ["i_top", "i_caution"]
    row = F.struct("t_top", "t_caution", "macro_f1", "cost", "top_recall")
    enough = F.when(F.col("top_recall") >= min_top_recall, 0).otherwise(1)
    best = grid.agg(
        F.min_by(row, F.struct(-F.col("macro_f1"), *place)).alias("macro_f1"),
        F.min_by(row, F.struct("cost", *place)).alias("cost"),
        F.min_by(row, F.struct(enough, "cost", *place)).alias("cost_with_recall"),
    )
    kinds = ["macro_f1", "cost", "cost_with_recall"]
    return best.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("b")) for k in kinds])).alias("r")
    ).select("r.criterion", "r.b.*")


def cost_envelope(grid: DataFrame) -> DataFrame:
    """Lowest cost per top threshold."""
    return grid.groupBy("t_top").agg(F.min("cost").alias("min_cost"))


def pair_cost_grid(
    df: DataFrame,
    y: str,
    p_alert: str,
    p_top: str,
    alert_grid: Sequence[float],
    top_grid: Sequence[float],
    w_fp: float = 1.0,
    w_fn: float = 3.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cost and top recall for pairs where the top stage also needs the alert threshold."""
    by = list(by)
    na, nt = len(alert_grid), len(top_grid)
    cells = (
        df.where(F.col(y).isNotNull())
        .groupBy(*by, reached(F.col(p_alert), alert_grid).alias("__a"), reached(F.col(p_top), top_grid).alias("__t"))
        .agg(
            F.count_if(F.col(y) == 0).alias("__neg"),
            F.count_if(F.col(y) >= 1).alias("__pos"),
            F.count_if(F.col(y) == 2).alias("__two"),
        )
    )
    totals = cells.groupBy(*by).agg(F.sum("__two").alias("__all2"))
    counts = ["__neg", "__pos", "__two"]
    dense = (
        totals.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(na))))
        .withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(nt))))
        .join(cells, [*by, "__a", "__t"], "left")
        .na.fill(0, counts)
    )
    above_a = Window.partitionBy(*by, "__t").orderBy(F.col("__a").desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto_a = Window.partitionBy(*by, "__t").orderBy("__a").rowsBetween(Window.unboundedPreceding, 0)
    above_t = Window.partitionBy(*by, "__a").orderBy(F.col("__t").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_t = Window.partitionBy(*by, "__a")
    high = dense.withColumns(
        {
            "__neg_a": F.coalesce(F.sum("__neg").over(above_a), F.lit(0)),
            "__two_a": F.coalesce(F.sum("__two").over(above_a), F.lit(0)),
            "__below": F.sum("__pos").over(upto_a),
        }
    )
    grid = high.withColumns(
        {
            "__hit": F.coalesce(F.sum("__two_a").over(above_t), F.lit(0)),
            "__fp": F.sum("__neg_a").over(all_t),
            "__fn": F.sum("__below").over(all_t),
        }
    ).where((F.col("__a") < na) & (F.col("__t") < nt))
    pick = lambda g, i: F.element_at(F.array(*[F.lit(v) for v in g]), F.col(i) + 1)
    return grid.select(
        *by,
        F.col("__a").alias("i_alert"),
        F.col("__t").alias("i_top"),
        pick(alert_grid, "__a").alias("t_alert"),
        pick(top_grid, "__t").alias("t_top"),
        (F.col("__fp") * F.lit(w_fp) + F.col("__fn") * F.lit(w_fn)).alias("cost"),
        (F.col("__hit") / F.greatest(F.col("__all2"), F.lit(1))).alias("top_recall"),
    )
