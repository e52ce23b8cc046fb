"""Series, panels and prediction tables derived from the test tables.

Each builder has a common table expression of the same name and content.  Money is
floored to whole units so that sums come out the same in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.stages import stage_from_value
from tideline.operators.resample import to_weekly
from tideline.operators.series import Series
from tideline.operators.windows import lookback

ROW_CUTS = [100_000, 250_000, 450_000]
DAY_CUTS = [1_000_000, 1_500_000, 2_000_000]
WEEK_CUTS = [400_000, 460_000, 490_000]

DAILY = Series(("key",), "day", daily=True)
WEEKLY_SERIES = Series(("key",), "week_start", daily=True)
SPARSE = Series(("cust",), "day", ("order_id",))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular samples: one row per order, no bound on rows per key."""
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("order_id"),
        F.floor("o_totalprice").cast("double").alias("v"),
        "o_orderstatus",
        "o_orderpriority",
    )


SPARSE_SQL = """sparse AS (
  SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, o_orderkey AS order_id,
         CAST(FLOOR(o_totalprice) AS DOUBLE) AS v, o_orderstatus, o_orderpriority
  FROM orders)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """One row per priority and day."""
    price = F.floor("o_totalprice")
    return (
        read(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"))
        .agg(
            F.sum(price).cast("double").alias("total"),
            F.max(price).cast("double").alias("top"),
            F.count(F.lit(1)).alias("n"),
        )
    )


PANEL_SQL = """panel AS (
  SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day,
         CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS DOUBLE) AS total,
         CAST(MAX(FLOOR(o_totalprice)) AS DOUBLE) AS top, COUNT(*) AS n
  FROM orders GROUP BY 1, 2)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with every third day and one longer stretch missing."""
    day = F.col("day")
    hole = (F.datediff(day, F.to_date(F.lit("1995-01-01"))) % 3 == 0) | day.between(
        F.to_date(F.lit("1996-02-01")), F.to_date(F.lit("1996-02-20"))
    )
    return panel(spark, sf).withColumn("v", F.when(~hole, F.col("total")))


GAPPY_SQL = """gappy AS (
  SELECT *, CASE WHEN (day - DATE '1995-01-01') % 3 = 0
                   OR day BETWEEN DATE '1996-02-01' AND DATE '1996-02-20'
                 THEN NULL ELSE total END AS v
  FROM panel)"""


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with a stage code per day."""
    return panel(spark, sf).withColumn("stage", stage_from_value(F.col("top"), WEEK_CUTS))


STAGED_SQL = """staged AS (
  SELECT *, CASE WHEN top >= 490000 THEN 3 WHEN top >= 460000 THEN 2
                 WHEN top >= 400000 THEN 1 ELSE 0 END AS stage
  FROM panel)"""


WEEK_SPEC = {
    "total_mean": ("total", "mean"),
    "total_max": ("total", "max"),
    "top_max": ("top", "max"),
    "n_sum": ("n", "sum"),
}


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    out = to_weekly(panel(spark, sf), ["key"], "day", WEEK_SPEC)
    return out.withColumns(
        {
            "total_mean": F.floor("total_mean").cast("double"),
            "n_sum": F.col("n_sum").cast("double"),
            "stage_max": stage_from_value(F.col("top_max"), WEEK_CUTS),
        }
    )


WEEKLY_SQL = """weekly AS (
  SELECT *, CASE WHEN top_max >= 490000 THEN 3 WHEN top_max >= 460000 THEN 2
                 WHEN top_max >= 400000 THEN 1 ELSE 0 END AS stage_max
  FROM (SELECT key, CAST(date_trunc('week', day) AS DATE) AS week_start,
               FLOOR(AVG(total)) AS total_mean, MAX(total) AS total_max, MAX(top) AS top_max,
               CAST(SUM(n) AS DOUBLE) AS n_sum
        FROM panel GROUP BY 1, 2))"""


WEEK_VALUES = ["total_mean", "total_max", "top_max", "n_sum", "stage_max"]


def supervised(spark: SparkSession, sf: str, periods: int = 4) -> DataFrame:
    """Look-back features and the labels of the row's own week."""
    return lookback(
        weekly(spark, sf),
        WEEKLY_SERIES,
        WEEK_VALUES,
        periods,
        short=["total_max", "top_max", "stage_max"],
        carry=["stage_max", "top_max"],
        labels={
            "y_max": F.col("top_max"),
            "y_mean": F.col("total_mean"),
            "y_stage": F.least(F.col("stage_max"), F.lit(3)),
            "y_alert": (F.col("stage_max") >= 2).cast("int"),
        },
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per station (return flag) and ship day."""
    return (
        read(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("station"), F.to_date("l_shipdate").alias("day"))
        .agg(F.avg("l_quantity").alias("qty"), F.max("l_quantity").alias("qty_max"))
    )


STATIONS_SQL = """stations AS (
  SELECT l_returnflag AS station, CAST(l_shipdate AS DATE) AS day,
         AVG(l_quantity) AS qty, MAX(l_quantity) AS qty_max
  FROM lineitem GROUP BY 1, 2)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Tie-rich class probabilities per line item, with truth 0/1/2."""
    p2 = F.col("l_discount") * 10
    part = F.pmod(F.col("l_quantity").cast("int") * 3 + F.col("l_linenumber"), F.lit(8)) / F.lit(8.0)
    return (
        read(spark, sf, "lineitem")
        .select(
            "l_orderkey",
            "l_linenumber",
            F.to_date("l_shipdate").alias("day"),
            F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("truth"),
            F.col("l_linestatus").alias("site"),
            F.col("l_quantity").alias("level"),
            p2.alias("p2"),
            ((1 - p2) * part).alias("p1"),
        )
        .withColumn("p_alert", F.col("p1") + F.col("p2"))
        .withColumn("pred", F.when(F.col("p2") >= 0.7, 2).when(F.col("p1") >= 0.4, 1).otherwise(0))
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT *, p1 + p2 AS p_alert,
         CASE WHEN p2 >= 0.7 THEN 2 WHEN p1 >= 0.4 THEN 1 ELSE 0 END AS pred
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS truth,
               l_linestatus AS site, l_quantity AS level,
               l_discount * 10 AS p2,
               (1 - l_discount * 10) * (((CAST(l_quantity AS INTEGER) * 3 + l_linenumber) % 8) / CAST(8 AS DOUBLE)) AS p1
        FROM lineitem))"""


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Event counts per user, day and type; a type without events is null."""
    kinds = ["click", "view", "purchase", "error", "signup"]
    events = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return events.groupBy(F.col("user_id").alias("key"), "day").pivot("event_type", kinds).count()


KINDS = ["click", "view", "purchase", "error", "signup"]

USER_DAYS_SQL = """user_days AS (
  SELECT user_id AS key, CAST(ts AS DATE) AS day, """ + ", ".join(
    f"NULLIF(COUNT(*) FILTER (WHERE event_type = '{k}'), 0) AS \"{k}\"" for k in KINDS
) + """
  FROM events GROUP BY 1, 2)"""
