"""Ordered series: the one place that decides how a keyed series is split.

Every positional operator (lags, rolling frames, streaks, fills, positions)
goes through this module, so that no operator has to trust that a key is small.

Two layouts, same results:

* ``daily=True`` states that the table holds at most one row per key and day
  (it came out of a ``groupBy(key, day)``).  A key then has at most 366 rows a
  year, a bound given by the calendar, and a plain window per key is right.
* otherwise a key may hold any share of the rows.  The series is cut into
  blocks; rows are windowed per (key, block), and what a block needs from its
  neighbours travels either as a halo of copied rows (bounded frames) or as a
  per-block summary (carry-over of the last value seen).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_POS = "__ser_pos"
_BUCKET = "__ser_bucket"
_HOME = "__ser_home"


@dataclass(frozen=True)
class Series:
    """Which columns make a series and how it may be split.

    ``bucket_days`` and ``tie_width`` set the buckets of the split layout: a
    bucket spans that many days and, where one day of one key is itself too
    large, that many values of the (numeric) first tie-break column.
    """

    keys: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    daily: bool = False
    bucket_days: int = 1
    tie_width: int | None = None
    block_rows: int = 100_000

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]

    def window(self, descending: bool = False) -> WindowSpec:
        cols = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*cols)

    def bucket(self) -> Column:
        day = F.floor(F.unix_date(F.to_date(F.col(self.time))) / F.lit(self.bucket_days))
        if self.tie_width is None:
            return F.struct(day.alias("day"))
        part = F.floor(F.col(self.tie[0]) / F.lit(self.tie_width))
        return F.struct(day.alias("day"), part.alias("part"))


def measured(
    df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = (), limit: int = 1_000_000
) -> Series:
    """A series whose layout is decided by looking at the row counts.

    One row per key and day: plain windows.  Otherwise the widest bucket (a year, a
    month, a week or a day) whose largest one stays within ``limit`` rows, so that
    small keys are not cut finer than the largest key needs.
    """
    count = F.sum("__ser_n")
    days = df.groupBy(*keys, F.unix_date(F.to_date(F.col(time))).alias("__ser_day")).agg(
        F.count(F.lit(1)).alias("__ser_n")
    )
    widths = [366, 30, 7, 1]
    sizes = days.withColumn("__ser_w", F.explode(F.array(*[F.lit(w) for w in widths])))
    largest = (
        sizes.groupBy(*keys, "__ser_w", F.floor(F.col("__ser_day") / F.col("__ser_w")).alias("__ser_b"))
        .agg(count.alias("__ser_n"))
        .groupBy("__ser_w")
        .agg(F.max("__ser_n").alias("__ser_n"))
    )
    top = {r["__ser_w"]: r["__ser_n"] for r in largest.collect()}  # one row per width
    if top.get(1, 0) <= 1:
        return Series(tuple(keys), time, tuple(tie), daily=True)
    fits = [w for w in widths if top[w] <= limit]
    return Series(tuple(keys), time, tuple(tie), bucket_days=fits[0] if fits else 1)


def complete(df: DataFrame, s: Series) -> DataFrame:
    """Rows without key or time belong to no series."""
    return df.na.drop(subset=[*s.keys, s.time])


def _by_bucket(df: DataFrame, s: Series, descending: bool = False) -> WindowSpec:
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in s.order]
    return Window.partitionBy(*s.keys, _BUCKET).orderBy(*cols)


def with_position(df: DataFrame, s: Series, name: str) -> DataFrame:
    """0-based row position inside each key, in (time, tie) order."""
    df = complete(df, s)
    if s.daily:
        return df.withColumn(name, (F.row_number().over(s.window()) - 1).cast("long"))
    cut = df.withColumn(_BUCKET, s.bucket())
    before = Window.partitionBy(*s.keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*s.keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("__ser_n"))
        .select(*s.keys, _BUCKET, F.coalesce(F.sum("__ser_n").over(before), F.lit(0)).alias("__ser_start"))
    )
    local = cut.withColumn("__ser_local", F.row_number().over(_by_bucket(cut, s)) - 1)
    return (
        local.join(starts, [*s.keys, _BUCKET])
        .withColumn(name, (F.col("__ser_start") + F.col("__ser_local")).cast("long"))
        .select(*df.columns, name)
    )




def over_series(
    df: DataFrame,
    s: Series,
    build: Callable[[WindowSpec, Column], dict[str, Column]]
    | list[Callable[[WindowSpec, Column], dict[str, Column]]],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows back and ``ahead`` on.

    ``build(window, position)`` returns the new columns; a list of builders is
    applied in turn (a rolling mean, then a lag of it).
    """
    builders = build if isinstance(build, list) else [build]
    if s.daily:
        out = complete(df, s)
        w = s.window()
        for b in builders:
            out = out.withColumns(b(w, (F.row_number().over(w) - 1).cast("long")))
        return out
    placed = with_position(df, s, _POS)
    size = max(s.block_rows, back, ahead)
    block = F.floor(F.col(_POS) / F.lit(size))
    inside = F.col(_POS) % F.lit(size)
    homes = [F.struct(block.alias("block"), F.lit(True).alias("own"))]
    if back:
        homes.append(
            F.when(inside >= size - back, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
        )
    if ahead:
        homes.append(
            F.when(
                (inside < ahead) & (block > 0),
                F.struct((block - 1).alias("block"), F.lit(False).alias("own")),
            )
        )
    spread = placed.withColumn(_HOME, F.explode(F.array_compact(F.array(*homes))))
    spread = spread.withColumn("__ser_block", F.col(f"{_HOME}.block")).withColumn("__ser_own", F.col(f"{_HOME}.own"))
    w = Window.partitionBy(*s.keys, "__ser_block").orderBy(_POS)
    for b in builders:
        spread = spread.withColumns(b(w, F.col(_POS)))
    return spread.where("__ser_own").drop(_POS, _HOME, "__ser_block", "__ser_own")


def neighbour(df: DataFrame, s: Series, cols: dict[str, str], step: int = -1) -> DataFrame:
    """Values of the row just before (``step=-1``) or after (``+1``) each row.

    The split layout shuffles the rows once, by (key, bucket): the row at a
    bucket's edge takes its neighbour from a summary of one row per bucket.
    """
    df = complete(df, s)
    shift = (lambda c, w: F.lag(c).over(w)) if step < 0 else (lambda c, w: F.lead(c).over(w))
    if s.daily:
        return df.withColumns({new: shift(F.col(old), s.window()) for new, old in cols.items()})
    cut = df.withColumn(_BUCKET, s.bucket())
    packed = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    order = F.struct(*s.order)
    edge = F.max_by(packed, order) if step < 0 else F.min_by(packed, order)
    edges = cut.groupBy(*s.keys, _BUCKET).agg(edge.alias("__ser_edge"))
    across = Window.partitionBy(*s.keys).orderBy(_BUCKET)
    edges = edges.withColumn("__ser_edge", shift(F.col("__ser_edge"), across))
    # Inside a bucket the neighbour is a struct; only a bucket's edge row has none.
    local = cut.withColumn("__ser_near", shift(packed, _by_bucket(cut, s)))
    joined = local.join(edges, [*s.keys, _BUCKET])
    return joined.withColumn("__ser_value", F.coalesce("__ser_near", "__ser_edge")).select(
        *df.columns, *[F.col(f"__ser_value.{new}").alias(new) for new in cols]
    )


def seen(
    df: DataFrame,
    s: Series,
    cols: dict[str, Column],
    forward: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Nearest non-null value at or before each row (``forward``: at or after).

    Looking forward is done by a descending order with an unbounded preceding
    frame, which Spark evaluates in one sweep.
    """
    df = complete(df, s)
    end = 0 if inclusive else -1

    def nearest(w: WindowSpec, c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))

    if s.daily:
        w = s.window(descending=forward)
        return df.withColumns({n: nearest(w, c) for n, c in cols.items()})
    cut = df.withColumn(_BUCKET, s.bucket()).withColumns({f"__ser_in_{n}": c for n, c in cols.items()})
    order = F.struct(*s.order)
    pick = F.min_by if forward else F.max_by
    summary = cut.groupBy(*s.keys, _BUCKET).agg(
        *[
            pick(F.col(f"__ser_in_{n}"), F.when(F.col(f"__ser_in_{n}").isNotNull(), order)).alias(f"__ser_carry_{n}")
            for n in cols
        ]
    )
    edge = F.col(_BUCKET).desc() if forward else F.col(_BUCKET).asc()
    across = Window.partitionBy(*s.keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {f"__ser_carry_{n}": F.last(f"__ser_carry_{n}", ignorenulls=True).over(across) for n in cols}
    )
    w = _by_bucket(cut, s, descending=forward)
    local = cut.withColumns({f"__ser_near_{n}": nearest(w, F.col(f"__ser_in_{n}")) for n in cols})
    joined = local.join(summary, [*s.keys, _BUCKET])
    new = {n: F.coalesce(F.col(f"__ser_near_{n}"), F.col(f"__ser_carry_{n}")) for n in cols}
    kept = [c for c in df.columns if c not in cols]
    return joined.select(*kept, *[c.alias(n) for n, c in new.items()])


def key_extent(df: DataFrame, s: Series, name: str) -> DataFrame:
    """Last time of each key on every row."""
    if s.daily:
        return df.withColumn(name, F.max(s.time).over(Window.partitionBy(*s.keys)))
    last = df.groupBy(*s.keys).agg(F.max(s.time).alias(name))
    return df.join(last, list(s.keys))
