"""Group summaries, rates, pivots, profiles and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.fixed_values import LAG_FAMILIES, LAG_FAMILY_OTHER
from tideline.operators.quantiles import column_quantile_rows, count_quantiles
from tideline.operators.series import Series, neighbour, with_position


def summarize(df: DataFrame, by: Sequence[str | Column], spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Grouped mean/max/min/sum/count; a sum over nothing is 0."""
    fns = {"mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
    aggs = [
        (F.coalesce(F.sum(c), F.lit(0.0)) if fn == "sum" else fns[fn](c)).alias(n)
        for n, (c, fn) in spec.items()
    ]
    return df.groupBy(*by).agg(*aggs)


def rate(holds: Column) -> Column:
    """Percentage of rows for which the predicate holds; null counts as no."""
    return F.avg(F.coalesce(holds, F.lit(False)).cast("double")) * 100


def rate_by(df: DataFrame, by: Sequence[str | Column], holds: Column, name: str = "rate") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(holds).alias(name))


def pivot_rate(df: DataFrame, row: str, col: str, values: Sequence[str], holds: Column) -> DataFrame:
    """Two-way table of a rate; empty cells stay null."""
    hit = df.where(F.col(row).isNotNull())
    return hit.groupBy(row).pivot(col, list(values)).agg(rate(holds))


def pivot_count(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def value_counts(df: DataFrame, col: str, n: int | None = None, name: str = "n") -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts if n is None else counts.orderBy(F.col(name).desc(), F.col(col)).limit(n)


def profile_by(
    df: DataFrame, by: Column, name: str, means: Sequence[str], holds: Column | None = None
) -> DataFrame:
    """Means, optional rate and row count per calendar part."""
    aggs = [F.avg(m).alias(f"mean_{m}") for m in means]
    if holds is not None:
        aggs.append(rate(holds).alias("rate"))
    return df.groupBy(by.alias(name)).agg(*aggs, F.count(F.lit(1)).alias("n"))


def lag_correlation(
    df: DataFrame, s: Series, x: str, y: str, lags: Sequence[int]
) -> DataFrame:
    """Pearson r of x against y some positions later, per key and lag.

    Missing values are left out of each side before positions are counted.  The two sides meet once, by
    position; all lags are then read from one sweep, in which a block of positions sees as many rows
    of its neighbours as the largest lag, and only sums leave it.
    """
    keys, cols = list(s.keys), [*s.keys, *s.order]
    xs = with_position(df.where(F.col(x).isNotNull()).select(*cols, F.col(x).alias("__x")), s, "__p").select(*keys, "__p", "__x")
    ys = with_position(df.where(F.col(y).isNotNull()).select(*cols, F.col(y).alias("__y")), s, "__p").select(*keys, "__p", "__y")
    met = xs.join(ys, [*keys, "__p"], "full")
    ahead, back = max(0, *lags), max(0, *[-n for n in lags])
    size = max(s.block_rows, ahead + 1, back + 1)
    block, inside = F.floor(F.col("__p") / size), F.col("__p") % size
    homes = [F.struct(block.alias("b"), F.lit(True).alias("own"))]
    if ahead:
        homes.append(F.when((inside < ahead) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
    if back:
        homes.append(F.when(inside >= size - back, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    spread = met.withColumn("__home", F.explode(F.array_compact(F.array(*homes)))).select(*keys, "__p", "__x", "__y", "__home.*")
    w = Window.partitionBy(*keys, "b").orderBy("__p")
    led = spread.withColumns({f"__y{i}": F.lead("__y", n).over(w) for i, n in enumerate(lags)}).where("own")
    pair = [F.when(F.col("__x").isNotNull() & F.col(f"__y{i}").isNotNull(), F.col("__x").cast("double")) for i in range(len(lags))]
    found = led.groupBy(*keys).agg(
        F.array(
            *[
                F.struct(F.lit(n).alias("lag"), F.corr(pair[i], F.col(f"__y{i}").cast("double")).alias("r"), F.count(pair[i]).alias("n"))
                for i, n in enumerate(lags)
            ]
        ).alias("found")
    )
    return found.select(*keys, F.inline("found")).where(F.col("n") > 0)


def best_lag(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag with the largest r; the smallest lag wins a tie."""
    return correlations.groupBy(*keys).agg(
        F.max_by("lag", F.struct("r", -F.col("lag"))).alias("best_lag"), F.max("r").alias("r")
    )


def composition_by(df: DataFrame, bin_col: str, parts: Sequence[str], holds: Column) -> DataFrame:
    """Mean percentage share of each part per bin, the leading part, and a rate."""
    out = (
        df.where(F.col(bin_col).isNotNull())
        .groupBy(bin_col)
        .agg(
            *[F.bround(F.avg(p) * 100, 1).alias(f"share_{p}") for p in parts],
            rate(holds).alias("rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    top = F.greatest(*[F.col(f"share_{p}") for p in parts])
    lead = F.coalesce(*[F.when(F.col(f"share_{p}") == top, F.lit(p)) for p in parts])
    return out.withColumn("dominant", lead)


def missing_rates(df: DataFrame, n: int | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of nulls per column from one pass, largest first."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = one.unpivot([], cols, "column_name", "missing_rate")
    return long if n is None else long.orderBy(F.col("missing_rate").desc(), "column_name").limit(n)


def median_gap(df: DataFrame, s: Series, name: str = "median_gap") -> DataFrame:
    """Median days between a key's successive rows."""
    gaps = neighbour(df.select(*s.keys, *s.order), s, {"__before": s.time})
    gaps = gaps.withColumn("__gap", F.datediff(F.col(s.time), F.col("__before")))
    return count_quantiles(gaps, "__gap", [0.5], s.keys, [name])


def mismatch_rate(df: DataFrame, a: str, b: str, name: str = "mismatch_rate") -> DataFrame:
    """Share of rows whose two encodings differ; a missing code counts as 0."""
    differ = F.coalesce(F.col(a), F.lit(0)) != F.coalesce(F.col(b), F.lit(0))
    return df.agg(F.avg(differ.cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles, max, distinct and missing share per column."""
    stats = df.agg(
        *[
            F.struct(
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("sd"),
                F.min(v).cast("double").alias("min"),
                F.max(v).cast("double").alias("max"),
                F.avg(F.col(v).isNull().cast("double")).alias("missing_rate"),
            ).alias(v)
            for v in values
        ]
    )
    rows = stats.select(
        F.explode(F.array(*[F.struct(F.lit(v).alias("column_name"), F.col(v).alias("x")) for v in values])).alias("r")
    ).select("r.column_name", "r.x.*")
    distinct = distinct_counts(df, values)
    quartiles = column_quantile_rows(df, values, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return rows.join(F.broadcast(distinct), "column_name", "left").join(
        F.broadcast(quartiles), "column_name", "left"
    )


def distinct_counts(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """column_name and n_distinct, the exact number of different non-null values (as numbers) per column.

    Columns of whole numbers become bitmaps: a task marks the values of each stretch of 32,768, and only the marked
    stretches are shuffled, however many rows they stand for. Other columns are read one by one, each by a
    scan of that column alone, and only its distinct values are shuffled.
    """
    whole = [c for c, kind in df.dtypes if c in values and kind in ("tinyint", "smallint", "int", "bigint")]
    out = None
    for c in values:
        own = df.select(F.col(c).alias("v")).where(F.col("v").isNotNull())
        if c in whole:
            n = own.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m"))
            count = n.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n_distinct"))
        else:
            count = own.select(F.col("v").cast("double").alias("v")).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
        count = count.select(F.lit(c).alias("column_name"), "n_distinct")
        out = count if out is None else out.unionByName(count)
    return out


def profile_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, missing share, distinct values, most frequent value and its count per column, of any type.

    Values are counted per column before anything is gathered; the smallest value wins a tie.
    """
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")
    ).select("x.*")
    counts = pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("__c"))
    known, present = F.col("v").isNotNull(), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("__c"))), F.lit(0))
    sums = counts.groupBy("column_name").agg(
        present.alias("n"),
        (1 - present / F.sum("__c")).alias("missing_rate"),
        F.count_if(known).alias("n_distinct"),
        F.max(F.when(known, F.col("__c"))).alias("top_n"),
    )
    tops = counts.where(known).join(F.broadcast(sums.select("column_name", F.col("top_n").alias("__c"))), ["column_name", "__c"])
    top = tops.groupBy("column_name").agg(F.min("v").alias("top"))
    return sums.join(F.broadcast(top), "column_name", "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*")


def histogram(df: DataFrame, value: str, width: int, name: str = "bin_start") -> DataFrame:
    """Fixed-width counts from 0 or the smallest value to the largest, empty bins included.

    Only the two ends come to the driver; the bins between are made in parallel.
    """
    bins = df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias(name))
    counts = bins.agg(F.count(F.lit(1)).alias("n"))
    lo, hi = counts.agg(F.min(name), F.max(name)).first()
    ends = (0, 0) if hi is None else (min(int(lo), 0), int(hi) + 1)
    span = df.sparkSession.range(*ends, width).select(F.col("id").alias(name))
    return span.join(counts, name, "left").na.fill(0, ["n"])


def top_pairs(df: DataFrame, score: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *tie).limit(n)


def recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of an order (a report of fixed length), oldest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def importance_families(
    importances: DataFrame, k: int, families: Sequence[tuple[str, str]] = LAG_FAMILIES, other: str = LAG_FAMILY_OTHER
) -> DataFrame:
    """Top-k features counted by name family, ``families`` = (pattern, label), first match."""
    label = reduce(lambda acc, f: F.when(F.col("feature").rlike(f[0]), f[1]).otherwise(acc), reversed(list(families)), F.lit(other))
    top = importances.orderBy(F.col("importance").desc(), "feature").limit(k)
    return top.groupBy(label.alias("family")).agg(F.count(F.lit(1)).alias("n"))


def to_percent(df: DataFrame, count: str = "n", name: str = "percent") -> DataFrame:
    """Shares of a small summary table, in percent to one digit."""
    total = F.sum(count).over(Window.partitionBy())
    return df.withColumn(name, F.bround(100 * F.col(count) / total, 1))
