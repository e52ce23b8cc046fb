"""Simple exponential smoothing with estimated factor and start level, for series of any length.

For a fixed factor a, a step takes the level l to (1 - a) l + a v and adds (v - l)^2 to the error. So a run of
values takes an entering level l to A l + B and adds P l^2 - 2 Q l + R, and two runs in a row are again such a
run. A series is cut into blocks; each gives its five numbers per factor, and blocks are composed ``FAN`` at a time
until one is left. The start level of least error is then Q / P, the forecast A l + B.

The factor is searched for all keys at once: every round tries a few factors of each key's interval, in one pass
over the blocks, and keeps the neighbourhood of the best.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.rows import floor_at
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.series import Series, with_position
from tideline.operators.splits import tail_split
from tideline.operators.windows import persistence
from tideline.session import cut_lineage

#: Values in a block, and blocks that are composed at once.
BLOCK, FAN = 512, 512
_RUN = ("a", "b", "p", "q", "r")


def _run(**parts: Column) -> Column:
    return F.struct(*[parts[c].alias(c) for c in _RUN])


def _nothing() -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return _run(a=one, b=zero, p=zero, q=zero, r=zero)


def _after(x: Column, factor: Column, v: Column) -> Column:
    """A run and one more value."""
    off = v - x["b"]
    return _run(
        a=(1 - factor) * x["a"], b=x["b"] + factor * off, p=x["p"] + x["a"] * x["a"], q=x["q"] + x["a"] * off, r=x["r"] + off * off
    )


def _both(x: Column, y: Column) -> Column:
    """A run followed by another."""
    return _run(
        a=x["a"] * y["a"],
        b=y["a"] * x["b"] + y["b"],
        p=x["p"] + y["p"] * x["a"] * x["a"],
        q=x["q"] + x["a"] * (y["q"] - y["p"] * x["b"]),
        r=x["r"] + (y["p"] * x["b"] - 2 * y["q"]) * x["b"] + y["r"],
    )


def _runs(blocks: DataFrame, keys: Sequence[str], factors: DataFrame, most: int) -> DataFrame:
    """keys, factors and the run of the whole series for each of them."""
    each = blocks.join(factors, list(keys))
    runs = F.transform("factors", lambda f: F.aggregate("values", _nothing(), lambda x, v: _after(x, f, v)))
    level = each.select(*keys, "block", "factors", runs.alias("runs"))
    while True:
        up = F.floor(F.col("block") / FAN).alias("up")
        parts = F.array_sort(F.collect_list(F.struct("block", "runs"))).alias("parts")
        grouped = level.groupBy(*keys, up).agg(F.first("factors").alias("factors"), parts)
        start = F.transform("factors", lambda _: _nothing())
        folded = F.aggregate("parts", start, lambda x, y: F.zip_with(x, y["runs"], _both))
        level = grouped.select(*keys, F.col("up").alias("block"), "factors", folded.alias("runs"))
        most = -(-most // FAN)
        if most <= 1:
            return level.drop("block")


def _solved(runs: DataFrame, keys: Sequence[str], estimated: bool) -> DataFrame:
    """keys, at, factor, start, error and forecast: one row per key and factor tried."""
    x = F.col("x.run")
    start = x["q"] / x["p"] if estimated else F.col("first")
    each = runs.select(*keys, "n", "mean", "first", F.posexplode(F.arrays_zip(F.col("factors").alias("factor"), F.col("runs").alias("run"))).alias("at", "x"))
    level = F.col("start")
    each = each.withColumn("start", start)
    return each.select(
        *keys, "n", "at", F.col("x.factor").alias("factor"), (level + F.col("mean")).alias("start"),
        F.greatest((x["p"] * level - 2 * x["q"]) * level + x["r"], F.lit(0.0)).alias("error"),
        (x["a"] * level + x["b"] + F.col("mean")).alias("forecast"),
    )


def _grid(low: Column, high: Column, points: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + (high - low) * i / (points - 1))


def fit_smoothing(
    df: DataFrame, s: Series, value: str, factors: Sequence[float] | None = None, start: str = "estimated", rounds: int = 8
) -> DataFrame:
    """keys, n, factor, start, error (sum of squared one-step errors), forecast.

    With ``factors`` one row per key and factor, in their order as ``at``; without, the factor of least error in
    [0, 1] per key, from 21 factors and ``rounds`` rounds that shrink the best one's interval to a quarter. ``start`` is
    the level of least error, or the first value (``first``). Rows without a value are left out.
    """
    keys = list(s.keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *s.order, F.col(value).cast("double").alias("__v"))
    placed = with_position(rows, s, "__p")
    cells = placed.groupBy(*keys, F.floor(F.col("__p") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("__p", "__v"))).alias("cells")
    )
    cells = cut_lineage(cells.select(*keys, "block", F.transform("cells", lambda c: c["__v"]).alias("values")))
    total = F.aggregate("values", F.lit(0.0), lambda x, v: x + v)
    per_key = cells.groupBy(*keys).agg(
        F.sum(F.size("values")).alias("n"), F.sum(total).alias("sum"), F.max("block").alias("last"), F.min_by(F.get("values", F.lit(0)), "block").alias("first")
    )
    mean = F.col("sum") / F.col("n")
    per_key = cut_lineage(per_key.select(*keys, "n", "last", mean.alias("mean"), (F.col("first") - mean).alias("first")))
    most = (per_key.agg(F.max("last")).first()[0] or 0) + 1
    # Smoothing moves with its series; about the mean, squares lose no digits.
    centred = cells.join(per_key.select(*keys, "mean"), keys).withColumn("values", F.transform("values", lambda v: v - F.col("mean"))).drop("mean")
    blocks = cut_lineage(centred)
    about = per_key.select(*keys, "n", "mean", "first")

    def tried(candidates: DataFrame) -> DataFrame:
        return _solved(_runs(blocks, keys, candidates, most).join(about, keys), keys, start == "estimated")

    if factors is not None:
        return tried(per_key.select(*keys, F.array(*[F.lit(float(f)) for f in factors]).alias("factors")))
    bounds = per_key.select(*keys, F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    for i in range(rounds + 1):
        points = 21 if i == 0 else 9
        found = tried(bounds.select(*keys, _grid(F.col("low"), F.col("high"), points).alias("factors")))
        best = found.groupBy(*keys).agg(F.min_by(F.struct("n", "factor", "start", "error", "forecast"), F.struct("error", "at")).alias("best"))
        step = (F.col("high") - F.col("low")) / (points - 1)
        joined = best.join(bounds, keys).withColumn("step", step)
        state = cut_lineage(
            joined.select(
                *keys, "best",
                F.greatest(F.col("best.factor") - F.col("step"), F.lit(0.0)).alias("low"), F.least(F.col("best.factor") + F.col("step"), F.lit(1.0)).alias("high"),
            )
        )
        bounds = state.select(*keys, "low", "high")
    return state.select(*keys, "best.*")


def smoothing_holdout(df: DataFrame, s: Series, value: str, share: float = 0.15, min_rows: int = 12) -> DataFrame:
    """Per key: mean absolute error of the flat forecast and of the previous value over the last ``share`` of the rows.

    Values below 0 count as 0; missing ones take the median of the key's training values, 0 without any. Factor and
    start level are estimated on the training rows. Keys with fewer than ``min_rows`` rows are left out.
    """
    keys = list(s.keys)
    split = tail_split(df, s, share).withColumn("__v", floor_at(F.col(value).cast("double"), 0.0))
    split = cut_lineage(split.select(*keys, *s.order, "split", "__v"))
    medians = exact_quantiles(split.where("split = 'train'"), "__v", [0.5], by=keys, names=["__median"])
    split = split.join(medians, keys, "left").withColumn("__v", F.coalesce("__v", "__median", F.lit(0.0))).drop("__median")
    split = cut_lineage(persistence(split, s, {"__prev": "__v"}))
    model = fit_smoothing(split.where("split = 'train'"), s, "__v").drop("n")
    test = F.col("split") == "test"
    sums = split.join(model.select(*keys, "forecast"), keys, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(test).alias("holdout_n"),
        F.avg(F.when(test, F.abs(F.col("__v") - F.col("__prev")))).alias("mae_naive"),
        F.avg(F.when(test, F.abs(F.col("__v") - F.col("forecast")))).alias("mae_smooth"),
    )
    return sums.where(F.col("n") >= min_rows).join(model, keys, "left")
