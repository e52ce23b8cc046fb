"""Metrics of prediction tables, each a fixed number of sums per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.rows import floor_at, to_log
from tideline.functions.stages import clamp
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.ranking import running_totals


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide by."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _r2(y: Column, p: Column) -> Column:
    """Share of the variance explained, over rows that have both; null without variance."""
    both = y.isNotNull() & p.isNotNull()
    sst = F.var_pop(F.when(both, y)) * F.count_if(both)
    return F.when(sst > 0, 1 - F.sum((y - p) * (y - p)) / sst)


def _f1(tp: Column, true: Column, pred: Column) -> Column:
    return _ratio(2.0 * tp, true + pred)


def confusion(df: DataFrame, y: str, p: str, labels: Sequence[int]) -> DataFrame:
    """Counts for every pair of labels, empty pairs included; pairs with other labels follow as they occur."""
    counts = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    codes = F.array(*[F.lit(i) for i in labels])
    grid = df.sparkSession.range(1).select(F.explode(codes).alias("truth")).withColumn("pred", F.explode(codes))
    both = (grid["truth"].eqNullSafe(counts["truth"])) & (grid["pred"].eqNullSafe(counts["pred"]))
    pair = [F.coalesce(grid[c], counts[c]).alias(c) for c in ("truth", "pred")]
    return grid.join(counts, both, "full").select(*pair, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_report(df: DataFrame, y: str, p: str, labels: Sequence[int]) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    sums = [
        F.struct(
            F.lit(c).alias("label"),
            F.count_if((F.col(y) == c) & (F.col(p) == c)).alias("tp"),
            F.count_if(F.col(y) == c).alias("support"),
            F.count_if(F.col(p) == c).alias("predicted"),
        )
        for c in labels
    ]
    rows = df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    tp, true, pred = F.col("tp"), F.col("support"), F.col("predicted")
    return rows.select(
        "label",
        _ratio(tp, pred).alias("precision"),
        _ratio(tp, true).alias("recall"),
        _f1(tp, true, pred).alias("f1"),
        "support",
        "predicted",
    )


def _macro_f1(cells: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Mean F1 over the classes seen in truth or prediction; cells are (tp, true, pred)."""
    total = reduce(add, [F.when(t + p > 0, _f1(tp, t, p)).otherwise(0.0) for tp, t, p in cells])
    seen = reduce(add, [F.when(t + p > 0, 1).otherwise(0) for _, t, p in cells])
    return _ratio(total, seen)


def alert_metrics(
    df: DataFrame,
    y: str,
    p: str,
    by: Sequence[str] = (),
    labels: Sequence[int] = (0, 1, 2),
    alert: int = 1,
    top: int = 2,
    min_n: int = 1,
) -> DataFrame:
    """Accuracy, macro and weighted F1, alert precision/recall/F1 and top-class recall."""
    t, q = F.col(y), F.col(p)
    base = df.where(t.isNotNull() & q.isNotNull())
    counted = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t == q).alias("__ok"),
        *[F.count_if((t == c) & (q == c)).alias(f"__tp{c}") for c in labels],
        *[F.count_if(t == c).alias(f"__t{c}") for c in labels],
        *[F.count_if(q == c).alias(f"__p{c}") for c in labels],
        F.count_if((t >= alert) & (q >= alert)).alias("__atp"),
        F.count_if(t >= alert).alias("__at"),
        F.count_if(q >= alert).alias("__ap"),
    )
    cells = [(F.col(f"__tp{c}"), F.col(f"__t{c}"), F.col(f"__p{c}")) for c in labels]
    weighted = reduce(add, [_f1(tp, true, pred) * true for tp, true, pred in cells])
    atp, at, ap = F.col("__atp"), F.col("__at"), F.col("__ap")
    return counted.where(F.col("n") >= min_n).select(
        *by,
        "n",
        (F.col("__ok") / F.col("n")).alias("accuracy"),
        _macro_f1(cells).alias("macro_f1"),
        _ratio(weighted, reduce(add, [true for _, true, _ in cells])).alias("weighted_f1"),
        _ratio(atp, ap).alias("alert_precision"),
        _ratio(atp, at).alias("alert_recall"),
        _f1(atp, at, ap).alias("alert_f1"),
        F.when(F.col(f"__t{top}") > 0, F.col(f"__tp{top}") / F.col(f"__t{top}")).alias("top_recall"),
    )


def mask_f1(df: DataFrame, y: str, p: str, cls: int, name: str = "f1") -> DataFrame:
    """F1 of one class against the rest."""
    tp = F.count_if((F.col(y) == cls) & (F.col(p) == cls))
    return df.agg(_f1(tp, F.count_if(F.col(y) == cls), F.count_if(F.col(p) == cls)).alias(name))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve, ties counted half; null where one class is absent.

    Rows collapse to one per distinct score before anything is ordered.
    """
    pos = (F.col(y) == 1).cast("long")
    neg = (F.col(y) == 0).cast("long")
    base = df.where(F.col(y).isNotNull())
    totals = running_totals(base, score, {"pos": pos, "neg": neg}, by)
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2)
    sums = totals.groupBy(*by).agg(F.sum(wins).alias("__w"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    both = F.col("__p").cast("double") * F.col("__n")
    return sums.select(*by, F.when(both > 0, F.col("__w") / both).alias(name))


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE on the log scale, MAE on the raw scale (floored at 0)."""
    base = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    raw = F.abs(F.expm1(y) - F.greatest(F.expm1(p), F.lit(0.0)))
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
        F.avg(F.abs(err)).alias("mae_log"),
        F.avg(raw).alias("mae_raw"),
        F.sqrt(F.avg(err * err)).alias("rmse_log"),
    )


def level_tertiles(df: DataFrame, value: str, name: str = "bucket", labels: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Bucket by the .33 and .66 quantiles, right-closed."""
    cuts = exact_quantiles(df, value, [0.33, 0.66], names=["__q1", "__q2"])
    out = df.join(F.broadcast(cuts), how="left")
    v = F.col(value)
    label = F.when(v <= F.col("__q1"), labels[0]).when(v <= F.col("__q2"), labels[1]).when(v.isNotNull(), labels[2])
    return out.withColumn(name, label).drop("__q1", "__q2")


def interval_metrics(df: DataFrame, y: str, lo: str, mid: str, hi: str, alphas: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Pinball loss per quantile, coverage, mean width and median's MAE."""
    losses = []
    for a, c in zip(alphas, (lo, mid, hi)):
        e = F.col(y) - F.col(c)
        losses.append(F.avg(F.greatest(a * e, (a - 1) * e)).alias(f"pinball_{round(a * 100)}"))
    inside = F.col(y).between(F.col(lo), F.col(hi))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *losses,
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col(hi) - F.col(lo)).alias("mean_width"),
        F.avg(F.abs(F.col(y) - F.col(mid))).alias("median_mae"),
    )


def compare_persistence(df: DataFrame, y: str, model: str, previous: str, value: str, model_value: str, previous_value: str) -> DataFrame:
    """Stage accuracy, value MAE and log-scale R2 of a model against the previous period.

    A missing previous stage is 0; rows with a missing previous value are left out of its MAE and take
    the median of the others in its R2.
    """
    prev = F.coalesce(clamp(F.col(previous), 0, 3), F.lit(0))
    middle = exact_quantiles(df, previous_value, [0.5], names=["__middle"])
    df = df.join(F.broadcast(middle), how="left")
    truth, known = to_log(F.col(value)), F.coalesce(F.col(previous_value), F.col("__middle"), F.lit(0.0))
    model_acc = F.avg((F.col(y) == F.col(model)).cast("double"))
    prev_acc = F.avg((F.col(y) == prev).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        prev_acc.alias("accuracy_persistence"),
        model_acc.alias("accuracy_model"),
        F.bround(model_acc - prev_acc, 4).alias("accuracy_delta"),
        F.avg(F.abs(F.col(value) - floor_at(F.col(previous_value), 0.0))).alias("mae_persistence"),
        F.avg(F.abs(F.col(value) - floor_at(F.col(model_value), 0.0))).alias("mae_model"),
        _r2(truth, to_log(known)).alias("r2_persistence"),
        _r2(truth, to_log(F.col(model_value))).alias("r2_model"),
    )


def tidy_metrics(df: DataFrame, run: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics as (run, ..., metric, value) rows."""
    wide = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(by), list(metrics), "metric", "value").withColumn("run", F.lit(run))


def compare_runs(runs: dict[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """One row per metric and one column per run."""
    rows = reduce(DataFrame.unionByName, [tidy_metrics(df, run, metrics) for run, df in runs.items()])
    return rows.groupBy("metric").pivot("run", list(runs)).agg(F.first("value"))
