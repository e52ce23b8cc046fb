"""Distributed ranks and running totals over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def hash_order(ids: Sequence[str], seed: int | str) -> Column:
    """A repeatable shuffle key: the md5 text of the row id and a seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def hash_rank(
    df: DataFrame,
    ids: Sequence[str],
    seed: int | str,
    by: Sequence[str] = (),
    name: str = "rank",
    digits: int = 3,
) -> DataFrame:
    """0-based rank of each row in hash order, inside each group.

    Hashes spread evenly, so their first ``digits`` hex digits cut even the largest
    group into 16 ** digits even parts; ranks are taken per part and shifted by the
    parts before.
    """
    by = list(by)
    hashed = df.withColumn("__h", hash_order(ids, seed)).withColumn("__b", F.substring("__h", 1, digits))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*by, "__b")
        .agg(F.count(F.lit(1)).alias("__c"))
        .select(*by, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    )
    part = Window.partitionBy(*by, "__b").orderBy("__h", *ids)
    local = hashed.withColumn("__local", F.row_number().over(part) - 1)
    return (
        local.join(starts, [*by, "__b"])
        .withColumn(name, (F.col("__start") + F.col("__local")).cast("long"))
        .select(*df.columns, name)
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """0-based rank of each row in a total order, of any type and any skew.

    Range partitioning sorts the table across tasks; a checkpoint pins the rows
    to their partitions, and one count per partition turns local into global ranks.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = cut_lineage(
        placed.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so the unpartitioned window stays small.
    parts = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__id").alias("__part_first"))
        .select("__part", "__part_first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    )
    return (
        placed.join(F.broadcast(parts), "__part")
        .withColumn(name, (F.col("__start") + F.col("__id") - F.col("__part_first")).cast("long"))
        .drop("__part", "__id", "__part_first", "__start")
    )


def running_totals(
    df: DataFrame, value: str, totals: dict[str, Column], by: Sequence[str] = (), parts: int = 128
) -> DataFrame:
    """Distinct values with their sums and the sums over all smaller values.

    ``totals`` are summed per distinct value first; ``before_<name>`` is the sum
    over smaller values.  Pivots from a sketch cut the values into ranges of even
    weight, so no task has to order the whole table.
    """
    # Fields of a struct compare null-safe, so a null group is a group like any other.
    group, by = list(by), ["__group"] if by else []
    base = df.where(F.col(value).isNotNull()).withColumns({g: F.struct(*group) for g in by})
    tied = base.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    probes = [i / parts for i in range(1, parts)]
    pivots = tied.groupBy(*by).agg(F.percentile_approx(value, probes, 1000).alias("__pivots"))
    joined = tied.join(pivots, by) if by else tied.crossJoin(F.broadcast(pivots))
    placed = joined.withColumn(
        "__r", F.size(F.filter("__pivots", lambda p: p <= F.col(value)))
    ).drop("__pivots")
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "__r")
        .agg(*[F.sum(n).alias(f"__s_{n}") for n in totals])
        .select(*by, "__r", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in totals])
    )
    inside = Window.partitionBy(*by, "__r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__l_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in totals})
    out = local.join(starts, [*by, "__r"])
    return out.select(
        *[F.col(by[0]).getField(g).alias(g) for g in group], value, *totals, *[(F.col(f"__s_{n}") + F.col(f"__l_{n}")).alias(f"before_{n}") for n in totals]
    )


def encode_key(df: DataFrame, key: str, name: str, first_seen: Sequence[str] | None = None) -> DataFrame:
    """Integer codes of a text column: sorted, or by first appearance in an order."""
    if first_seen is None:
        codes = global_rank(df.select(key).distinct(), [key], name)
    else:
        first = df.groupBy(key).agg(F.min(F.struct(*first_seen)).alias("__first"))
        codes = global_rank(first, ["__first", key], name).drop("__first")
    return df.join(codes.withColumn(name, F.col(name).cast("int")), key, "left")
