"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import scratch_path

#: A word of a text: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed, as in a checkout."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8_length(text: Column) -> Column:
    """Bytes of a text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def rank_in_groups(df: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """0-based gapless rank of each row inside its group, for groups of any size.

    Rows are cut into even ranges of ``order`` and written, which pins them. A group's rank is
    the rank inside one range plus the group's rows in earlier ranges, so no task holds a group:
    only one row per range and group is ever gathered. Equal rows get distinct ranks.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    placed = stash(
        tied.repartitionByRange(*[F.col(c) for c in order], "__tie").withColumn("__part", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part", by)
        .agg(F.count(F.lit(1)).alias("__c"))
        .select("__part", F.col(by).alias("__by"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy("__part", by).orderBy(*order, "__tie")
    local = placed.withColumn("__local", F.row_number().over(inside) - 1)
    joined = local.join(
        starts.withColumnRenamed("__part", "__p"), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by"))
    )
    return joined.select(*df.columns, (F.col("__start") + F.col("__local")).cast("long").alias(name))
