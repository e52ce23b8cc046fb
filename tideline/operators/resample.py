"""Densification, gap filling, week and station roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.quantiles import exact_quantiles
from tideline.operators.series import Series, neighbour, seen, with_position


def expand_growth(df: DataFrame, s: Series, values: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Sparse samples to one row per day by exponential growth between samples.

    Each interval [start, next) yields its days; the last sample of a key is kept
    as it is.  Two samples on one day span no days, so only the later one lives.
    The next sample comes from one shuffle; the days are then generated in place.
    """
    day = F.to_date(F.col(s.time))
    flat = df.select(*s.keys, *s.order, *values)
    ahead = neighbour(flat, s, {"__next_t": s.time, **{f"__next_{v}": v for v in values}}, step=1)
    span = F.datediff(F.col("__next_t"), F.col(s.time))
    offsets = (
        F.when(F.col("__next_t").isNull(), F.array(F.lit(0)))
        .when(F.col("__span") > 0, F.sequence(F.lit(0), F.col("__span") - 1))
        .otherwise(F.array().cast("array<int>"))
    )
    rows = ahead.withColumn("__span", span).withColumn("__i", F.explode(offsets))
    out = {}
    for v in values:
        y0 = F.col(v) + F.lit(eps)
        rate = F.log((F.col(f"__next_{v}") + F.lit(eps)) / y0) / F.col("__span")
        out[v] = F.when(F.col("__next_t").isNull(), F.col(v)).otherwise(y0 * F.exp(rate * F.col("__i")))
    return rows.select(
        *s.keys,
        F.date_add(day, F.col("__i")).alias(s.time),
        *[c.alias(v) for v, c in out.items()],
    )


def interpolate_linear(
    df: DataFrame, s: Series, values: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Straight lines over row positions; a trailing gap repeats the last value.

    ``limit`` fills only the first so many rows of a gap, on the full gap's slope.
    Leading gaps stay empty (``fill_edges`` closes them).
    """
    placed = with_position(df, s, "__p")

    def known(v: str) -> Column:
        return F.when(
            F.col(v).isNotNull(), F.struct(F.col("__p").alias("p"), F.col(v).cast("double").alias("v"))
        )

    out = seen(placed, s, {f"__a_{v}": known(v) for v in values})
    out = seen(out, s, {f"__b_{v}": known(v) for v in values}, forward=True)
    new = {}
    for v in values:
        a, b, p = F.col(f"__a_{v}"), F.col(f"__b_{v}"), F.col("__p")
        blend = a["v"] + (b["v"] - a["v"]) * (p - a["p"]) / (b["p"] - a["p"])
        filled = F.when(b.isNull(), a["v"]).otherwise(blend)
        within = F.lit(True) if limit is None else (p - a["p"]) <= limit
        new[v] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).when(a.isNotNull() & within, filled)
    helper = ["__p", *[f"__{x}_{v}" for v in values for x in "ab"]]
    return out.withColumns(new).drop(*helper)


def fill_edges(df: DataFrame, s: Series, values: Sequence[str]) -> DataFrame:
    """Backfill, then forward-fill."""
    out = seen(df, s, {f"__b_{v}": F.col(v) for v in values}, forward=True)
    out = seen(out, s, {f"__a_{v}": F.col(v) for v in values})
    new = {v: F.coalesce(F.col(v), F.col(f"__b_{v}"), F.col(f"__a_{v}")) for v in values}
    return out.withColumns(new).drop(*[f"__{x}_{v}" for v in values for x in "ab"])


def ffill_zero(df: DataFrame, s: Series, values: Sequence[str]) -> DataFrame:
    """Forward-fill, then 0."""
    out = seen(df, s, {f"__a_{v}": F.col(v) for v in values})
    new = {v: F.coalesce(F.col(f"__a_{v}"), F.lit(0.0)) for v in values}
    return out.withColumns(new).drop(*[f"__a_{v}" for v in values])


def fill_chain(df: DataFrame, s: Series, values: Sequence[str]) -> DataFrame:
    """Interpolate in both directions, then the key's median, then 0."""
    out = fill_edges(interpolate_linear(df, s, values), s, values)
    if s.daily:  # the calendar bounds what one key's median has to hold
        medians = df.groupBy(*s.keys).agg(*[F.percentile(v, 0.5).alias(f"__med_{v}") for v in values])
        out = out.join(medians, list(s.keys), "left")
    else:
        for v in values:
            med = exact_quantiles(df, v, [0.5], by=s.keys, names=[f"__med_{v}"])
            out = out.join(med, list(s.keys), "left")
    new = {v: F.coalesce(F.col(v), F.col(f"__med_{v}"), F.lit(0.0)) for v in values}
    return out.withColumns(new).drop(*[f"__med_{v}" for v in values])


def week_start(time: str) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", F.col(time)).cast("date")


def to_weekly(
    df: DataFrame, keys: Sequence[str], time: str, spec: dict[str, tuple[str, str]], name: str = "week_start"
) -> DataFrame:
    """Monday-to-Sunday roll-up, ``{out: (column, mean|max|min|sum)}``.

    A sum over nothing is 0, the other aggregates stay empty.
    """
    fns = {"mean": F.avg, "max": F.max, "min": F.min}
    aggs = [
        (F.coalesce(F.sum(c), F.lit(0.0)) if fn == "sum" else fns[fn](c)).alias(out)
        for out, (c, fn) in spec.items()
    ]
    return df.groupBy(*keys, week_start(time).alias(name)).agg(*aggs)


def average_over(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Station roll-up: the mean of each value over all stations of a day."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
