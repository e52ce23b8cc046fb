"""Joins: attaching side tables, and day-range joins around events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join on key and time."""
    return df.join(other, list(on), "left")


def attach_daily(df: DataFrame, series: DataFrame, time: str) -> DataFrame:
    """Left join of a table with one row per day onto every key's rows.

    Such a table is small as a rule; whether it is sent to every task is left to Spark, which knows its size.
    """
    return df.join(series, time, "left")


def prefer_right(df: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join where the right side's version of shared columns wins."""
    right = other.select(*on, *[F.col(c).alias(f"__r_{c}") for c in cols])
    joined = df.drop(*cols).join(right, list(on), "left")
    return joined.withColumnsRenamed({f"__r_{c}": c for c in cols})


def align_mean(
    df: DataFrame, other: DataFrame, time: str, values: Sequence[str], default: float
) -> DataFrame:
    """Mean of ``values`` over all keys of the same day; ``default`` on days without any."""
    means = other.groupBy(time).agg(*[F.avg(v).alias(f"aligned_{v}") for v in values])
    out = df.join(means, time, "left")
    return out.withColumns({f"aligned_{v}": F.coalesce(F.col(f"aligned_{v}"), F.lit(default)) for v in values})


def _day(c: str) -> Column:
    return F.unix_date(F.to_date(F.col(c)))


def _range_pairs(
    events: DataFrame, rows: DataFrame, keys: Sequence[str], event_time: str, time: str, lo: int, hi: int
) -> DataFrame:
    """Pairs with ``event + lo <= row <= event + hi`` in days, as an equi-join.

    Days are cut into buckets as wide as the range, so a range touches at most
    two of them and every pair meets in exactly one bucket: the row's.
    """
    width = hi - lo + 1
    reach = F.sequence(
        F.floor((_day(event_time) + lo) / width), F.floor((_day(event_time) + hi) / width)
    )
    left = events.withColumn("__bucket", F.explode(reach))
    right = rows.withColumn("__bucket", F.floor(_day(time) / width))
    gap = F.datediff(F.col(time), F.col(event_time))
    return left.join(right, [*keys, "__bucket"]).where(gap.between(lo, hi)).drop("__bucket")


def after_events(
    events: DataFrame, rows: DataFrame, keys: Sequence[str], event_time: str, time: str, days: int
) -> DataFrame:
    """Rows in (event, event + days], one output row per pair.

    Meant for rows unique per key and day (at most ``days`` per event); where a day may
    hold many rows, ``range_totals`` sums them before anything is paired.
    """
    return _range_pairs(events, rows, keys, event_time, time, 1, days)


def before_events(
    events: DataFrame, rows: DataFrame, keys: Sequence[str], event_time: str, time: str, days: int
) -> DataFrame:
    """Rows in [event - days, event); see ``after_events``."""
    return _range_pairs(events, rows, keys, event_time, time, -days, -1)


def range_totals(
    events: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    event_time: str,
    time: str,
    lo: int,
    hi: int,
    sums: dict[str, Column],
) -> DataFrame:
    """Per event, sums over the rows of a day range, without pairing rows.

    Rows are summed per key and day and events reduced to distinct key-days
    first, so an event meets at most one row per day of its range however many
    rows a key holds.
    """
    daily = rows.groupBy(*keys, F.to_date(time).alias("__day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    days = events.select(*keys, F.to_date(event_time).alias("__event")).distinct()
    pairs = _range_pairs(days, daily, keys, "__event", "__day", lo, hi)
    totals = pairs.groupBy(*keys, "__event").agg(*[F.sum(n).alias(n) for n in sums])
    keyed = events.withColumn("__event", F.to_date(event_time))
    out = keyed.join(totals, [*keys, "__event"], "left").drop("__event")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def mark_in_windows(
    rows: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    event_time: str,
    days: int,
    name: str,
) -> DataFrame:
    """1 for rows in [event - days, event) of any event; with no keys, of any key's event.

    Events become the set of days they cover, so the rows meet at most one match.
    """
    covered = (
        events.select(*keys, F.to_date(event_time).alias("__event"))
        .distinct()
        .select(*keys, F.explode(F.sequence(F.date_sub("__event", days), F.date_sub("__event", 1))).alias("__day"))
        .distinct()
        .withColumn(name, F.lit(1))
    )
    keyed = rows.withColumn("__day", F.to_date(time))
    out = keyed.join(covered, [*keys, "__day"], "left").drop("__day")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
