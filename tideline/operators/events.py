"""Onsets, delayed responses, transitions, episodes and detection leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import mark_in_windows, range_totals
from tideline.operators.quantiles import count_quantiles
from tideline.operators.series import Series, key_extent, neighbour, over_series, seen


def event_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """0/1 flags from predicates; unknown counts as 0."""
    return df.withColumns({n: F.coalesce(p, F.lit(False)).cast("int") for n, p in flags.items()})


def onset(df: DataFrame, s: Series, flag: str, name: str, default: int | None = 0) -> DataFrame:
    """1 where a flag switches on; ``default=None`` never fires on a key's first row."""
    out = neighbour(df, s, {"__prev": flag})
    prev = F.col("__prev") if default is None else F.coalesce(F.col("__prev"), F.lit(default))
    fires = F.coalesce((F.col(flag) == 1) & (prev == 0), F.lit(False))
    return out.withColumn(name, fires.cast("int")).drop("__prev")


def first_hit_after(df: DataFrame, s: Series, hit: Column, name: str) -> DataFrame:
    """Date of the next hit on a later day."""
    return seen(df, s, {name: F.when(hit, F.col(s.time))}, forward=True, inclusive=False)


def delays(df: DataFrame, s: Series, event: str, hit: Column, days: int) -> DataFrame:
    """Event rows with the days to their first hit within ``days``, null without one.

    The next hit comes from one backward sweep, so events and hits are never paired.
    """
    flat = first_hit_after(df, s, hit, "__hit")
    wait = F.datediff(F.col("__hit"), F.col(s.time))
    return (
        flat.where(F.col(event) == 1)
        .withColumn("delay", F.when(wait <= days, wait))
        .drop("__hit")
    )


def delayed_response(df: DataFrame, s: Series, event: str, hit: Column, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Events, share answered within ``days`` (percent) and median delay."""
    found = delays(df, s, event, hit, days)
    totals = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count("delay").alias("hits"),
        (F.count("delay") / F.count(F.lit(1)) * 100).alias("hit_rate"),
    )
    medians = count_quantiles(found, "delay", [0.5], by, ["median_delay"])
    return totals.join(medians, list(by)) if by else totals.crossJoin(F.broadcast(medians))


def post_event_count(df: DataFrame, s: Series, event: str, hit: Column, days: int) -> DataFrame:
    """Event rows with the number of hits in the following ``days``."""
    events = df.where(F.col(event) == 1)
    return range_totals(
        events,
        df,
        s.keys,
        s.time,
        s.time,
        1,
        days,
        {"hits": F.coalesce(hit, F.lit(False)).cast("long")},
    )


def transitions(df: DataFrame, s: Series, state: str, states: Sequence[int]) -> DataFrame:
    """Counts of successive states over all keys, zero-filled over ``states``; other states follow as they occur."""
    steps = neighbour(df, s, {"__prev": state}).where(F.col("__prev").isNotNull())
    counts = steps.groupBy(F.col("__prev").alias("prev"), F.col(state).alias("curr")).agg(
        F.count(F.lit(1)).alias("n")
    )
    codes = F.array(*[F.lit(i) for i in states])
    grid = df.sparkSession.range(1).select(F.explode(codes).alias("prev")).withColumn("curr", F.explode(codes))
    both = grid["prev"].eqNullSafe(counts["prev"]) & grid["curr"].eqNullSafe(counts["curr"])
    pair = [F.coalesce(grid[c], counts[c]).alias(c) for c in ("prev", "curr")]
    return grid.join(counts, both, "full").select(*pair, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def transition_rows(df: DataFrame, s: Series, state: str, prev: int, curr: int) -> DataFrame:
    """Rows at which the state went from ``prev`` to ``curr``."""
    steps = neighbour(df, s, {"__prev": state})
    return steps.where((F.col("__prev") == prev) & (F.col(state) == curr)).drop("__prev")


def pre_event_means(
    events: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, days: int, values: Sequence[str]
) -> DataFrame:
    """Mean over events of the mean over each event's preceding days."""
    keyed = events.select(*keys, F.col(time).alias("__at"))
    sums = {f"__s_{v}": F.col(v) for v in values} | {
        f"__n_{v}": F.when(F.col(v).isNotNull(), 1).otherwise(0) for v in values
    }
    per_event = range_totals(keyed, rows, keys, "__at", time, -days, -1, sums)
    means = [F.avg(F.col(f"__s_{v}") / F.nullif(F.col(f"__n_{v}"), F.lit(0))).alias(f"pre_{v}") for v in values]
    return per_event.agg(*means, F.count(F.lit(1)).alias("events"))


def pre_event_contrast(
    events: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    days: int,
    values: Sequence[str],
    across_keys: bool = False,
) -> DataFrame:
    """Means of rows shortly before an event against all other rows."""
    on = [] if across_keys else list(keys)
    marked = mark_in_windows(rows, events.withColumnRenamed(time, "__at"), on, time, "__at", days, "before_event")
    return marked.groupBy("before_event").agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values], F.count(F.lit(1)).alias("n")
    )


def episode_starts(df: DataFrame, s: Series, holds: Column, name: str = "__start") -> DataFrame:
    """Marks rows where an episode opens: the predicate holds and did not before.

    An unknown predicate neither opens nor closes an episode.
    """
    out = seen(df, s, {"__was": holds.cast("int")}, inclusive=False)
    opens = F.coalesce(holds, F.lit(False)) & (F.coalesce(F.col("__was"), F.lit(0)) == 0)
    return out.withColumn(name, opens).drop("__was")


def episodes(
    df: DataFrame,
    s: Series,
    holds: Column,
    detect: Column | None = None,
    window: int = 30,
    earliest: bool = False,
) -> DataFrame:
    """Episodes of a predicate: start, end, length, whether still open.

    An episode ends the day before the first break, an open one at the key's last
    row.  With ``detect`` each episode also gets the date of the latest
    (``earliest``: first) detection among the last ``window`` rows up to its start,
    the lead in days and a detected flag.
    """
    out = episode_starts(df, s, holds)
    out = seen(out, s, {"__break": F.when(~holds, F.col(s.time))}, forward=True)
    out = key_extent(out, s, "__last")
    if detect is not None:
        pick = F.min if earliest else F.max
        out = over_series(
            out,
            s,
            lambda w, _: {
                "__found": pick(F.when(detect, F.col(s.time))).over(w.rowsBetween(-window + 1, 0))
            },
            back=window - 1,
        )
    end = F.coalesce(F.date_sub("__break", 1), F.col("__last"))
    cols = [
        *s.keys,
        F.col(s.time).alias("start"),
        end.alias("end"),
        (F.datediff(end, F.col(s.time)) + 1).alias("length"),
        F.col("__break").isNull().alias("open"),
    ]
    if detect is not None:
        lead = F.datediff(F.col(s.time), F.col("__found"))
        cols += [lead.alias("lead"), F.col("__found").isNotNull().alias("detected")]
    return out.where("__start").select(*cols)


def last_match_before(df: DataFrame, s: Series, match: Column, n: int, name: str) -> DataFrame:
    """Latest matching date among the last n rows up to and including each row."""
    return over_series(
        df,
        s,
        lambda w, _: {name: F.max(F.when(match, F.col(s.time))).over(w.rowsBetween(-n + 1, 0))},
        back=n - 1,
    )


def lead_summary(episodes_df: DataFrame) -> DataFrame:
    """Counts of detected and missed episodes with mean, median and largest lead."""
    base = episodes_df.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("detected").alias("detected"),
        F.count_if(~F.col("detected")).alias("missed"),
        F.avg("lead").alias("mean_lead"),
        F.max("lead").alias("max_lead"),
        F.percentile("lead", 0.5).alias("median_lead"),
    )
    return base
