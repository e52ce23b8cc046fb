"""Time splits, folds, class weights and repeatable sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ranking import global_rank, hash_order, hash_rank
from tideline.operators.series import Series, with_position
from tideline.session import cut_lineage


def holdout_cut(df: DataFrame, time: str, share: float, name: str = "cut") -> DataFrame:
    """One row: the last training date, ``share`` of the distinct dates lie after it.

    Distinct dates are a calendar's worth of rows, whatever the table holds.
    """
    dates = df.select(F.col(time).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    ranked = dates.select(
        "__t",
        F.row_number().over(Window.orderBy("__t")).alias("__i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"),
    )
    last = F.greatest(F.floor(F.col("__n") * (1.0 - share)), F.lit(1))
    return ranked.where(F.col("__i") == last).select(F.col("__t").alias(name))


def time_holdout(df: DataFrame, time: str, share: float = 0.15, name: str = "split") -> DataFrame:
    """Column ``train``/``test``: rows up to the cut date train, later ones test."""
    cut = F.broadcast(holdout_cut(df, time, share, "__cut"))
    label = F.when(F.col(time) <= F.col("__cut"), "train").when(F.col(time) > F.col("__cut"), "test")
    return df.join(cut, how="left").withColumn(name, label).drop("__cut")


def split_by_dates(df: DataFrame, time: str, first_val: str, first_test: str, name: str = "split") -> DataFrame:
    day = F.col(time)
    label = (
        F.when(day < F.to_date(F.lit(first_val)), "train")
        .when(day < F.to_date(F.lit(first_test)), "val")
        .otherwise("test")
    )
    return df.withColumn(name, label)


def tail_split(df: DataFrame, s: Series, share: float = 0.15, name: str = "split") -> DataFrame:
    """Each key's first rows train, its last ``share`` test, by position."""
    placed = with_position(df, s, "__p")
    counts = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("__n"))
    out = placed.join(counts, list(s.keys))
    label = F.when(F.col("__p") < F.floor(F.col("__n") * (1.0 - share)), "train").otherwise("test")
    return out.withColumn(name, label).drop("__p", "__n")


def expanding_folds(df: DataFrame, s: Series, n: int = 3, name: str = "fold") -> DataFrame:
    """Fold number 0..n by time order over all keys.

    Block i is tested by a model trained on blocks 0..i-1; block 0 only trains.
    Blocks have rows // (n + 1) rows each, block 0 takes the rest, as in an
    expanding time-series split.  Counts per time give the borders; a time that lies
    between two borders needs no order.  Rows without key or time are left out.
    """
    rows = df.na.drop(subset=[*s.keys, s.time])
    counts = rows.groupBy(s.time).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy(s.time).rowsBetween(Window.unboundedPreceding, -1)
    # One row per time, which a calendar bounds.
    times = counts.select(
        s.time, "__c", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first"), F.sum("__c").over(Window.partitionBy()).alias("__n")
    )

    def fold(p: Column) -> Column:
        size = F.floor(F.col("__n") / (n + 1))
        first = F.col("__n") - size * n
        return F.when(p < first, 0).otherwise(F.floor((p - first) / size) + 1).cast("int")

    times = times.withColumns({name: fold(F.col("__first")), "__to": fold(F.col("__first") + F.col("__c") - 1)})
    times = cut_lineage(times)
    placed = rows.join(times, s.time)
    inside = placed.where(F.col(name) == F.col("__to")).select(*df.columns, name)
    # Only rows of the times at a border are ordered, at most n of them.
    border = placed.where(F.col(name) != F.col("__to"))
    start = times.where(F.col(name) != F.col("__to")).select(
        F.col(s.time).alias("__time"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__skipped")
    )
    ranked = global_rank(border, [s.time, *s.keys, *s.tie], "__rank").join(F.broadcast(start), F.col(s.time) == F.col("__time"))
    position = F.col("__first") + F.col("__rank") - F.col("__skipped")
    return inside.unionByName(ranked.withColumn(name, fold(position)).select(*df.columns, name))


def class_weight_table(df: DataFrame, y: str, boost: dict[int, float] | None = None, name: str = "weight") -> DataFrame:
    """n / (k * n_c) per class, chosen classes boosted; one row per class."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy()  # one row per class
    weight = F.sum("__c").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("__c"))
    for cls, factor in (boost or {}).items():
        weight = F.when(F.col(y) == cls, weight * factor).otherwise(weight)
    return counts.select(y, weight.alias(name))


def class_weights(df: DataFrame, y: str, boost: dict[int, float] | None = None, name: str = "weight") -> DataFrame:
    return df.join(F.broadcast(class_weight_table(df, y, boost, name)), y, "left")


def year_class_weights(
    df: DataFrame, y: str, year: Column, boosts: dict[int, float], base: float, boost: dict[int, float], name: str = "weight"
) -> DataFrame:
    """Class weight times year weight, scaled to mean 1 over the table."""
    by_year = F.lit(base)
    for k, v in boosts.items():
        by_year = F.when(year == k, F.lit(v)).otherwise(by_year)
    raw = class_weights(df, y, boost, "__cw").withColumn("__w", F.col("__cw") * by_year)
    mean = raw.agg(F.avg("__w").alias("__mean"))
    return (
        raw.join(F.broadcast(mean), how="left").withColumn(name, F.col("__w") / F.col("__mean")).drop("__cw", "__w", "__mean")
    )


def scale_pos_weight(df: DataFrame, y: str, name: str = "scale_pos_weight") -> DataFrame:
    pos = F.greatest(F.count_if(F.col(y) == 1), F.lit(1))
    neg = F.greatest(F.count_if(F.col(y) == 0), F.lit(1))
    return df.agg((neg / pos).alias(name))


def oversample(
    df: DataFrame,
    y: str,
    cls: int,
    ids: Sequence[str],
    target: int | None = None,
    ratio: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Repeat one class's rows until it has ``target`` rows, or ``ratio`` times the rest.

    Copies are spread evenly: every row is repeated floor(target / n) times and the
    rows first in hash order once more.  A class already large enough is left as it
    is.  ``copy`` numbers the repeats; ids stay, so a copy leads back to its source.
    """
    wanted = (
        F.lit(int(target)).cast("long")
        if target is not None
        else F.floor(F.count_if(F.col(y) != cls) * F.lit(float(ratio))).cast("long")
    )
    sizes = df.agg(F.count_if(F.col(y) == cls).alias("__n"), wanted.alias("__want"))
    members = hash_rank(df.where(F.col(y) == cls), ids, seed, name="__rank").join(F.broadcast(sizes), how="left")
    want = F.greatest("__want", "__n")
    copies = F.floor(want / F.col("__n")) + F.when(F.col("__rank") < want % F.col("__n"), 1).otherwise(0)
    repeated = members.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*df.columns, "copy")
    rest = df.where((F.col(y) != cls) | F.col(y).isNull()).withColumn("copy", F.lit(1))
    return rest.unionByName(repeated)


def sample_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, the same ones on every run: the first n in hash order.

    Rows are counted by the first digits of their hash (65,536 counters).  All rows below the digits at which n is
    reached are in; only the rows that share those digits, about one in 65,536, are put in order.
    """
    hashed = df.withColumn("__h", hash_order(ids, seed)).withColumn("__b", F.substring("__h", 1, 4))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.select("__b", "c", F.sum("c").over(Window.orderBy("__b")).alias("upto"))
    edge = upto.where(F.col("upto") >= n).orderBy("__b").first()
    if edge is None:
        return df
    last, before = edge["__b"], edge["upto"] - edge["c"]
    below = hashed.where(F.col("__b") < last).select(*df.columns)
    border = hashed.where(F.col("__b") == last).orderBy("__h", *ids).limit(n - before).select(*df.columns)
    return below.unionByName(border)


def split_summary(df: DataFrame, split: str, y: str, classes: Sequence[int]) -> DataFrame:
    counts = [F.count_if(F.col(y) == c).alias(f"n_{c}") for c in classes]
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *counts)
