"""Scans of panels, prediction tables and recommendation documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ACTION_DOC = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("조건", T.StringType()),
        T.StructField("예상", T.StringType()),
        T.StructField("권고", T.ArrayType(T.StringType())),
    ]
)


def read_panel(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Delimited panel with a header; a byte-order mark is dropped by the reader.

    ``encoding='cp949'`` needs a session with ``spark.sql.legacy.javaCharsets=true``.
    Without a schema every column is text, to be typed by ``coerce_types``.
    """
    reader = spark.read.option("header", True)
    if encoding.lower() in ("cp949", "x-windows-949", "ms949"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", "x-windows-949")
    elif encoding.upper() not in ("UTF-8", "UTF-8-SIG"):
        reader = reader.option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_optional(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame | None:
    """The table, or None where the path does not exist (on any file system)."""
    try:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_recommendations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Recommendation documents: one array per file, or (``lines``) one object per line."""
    schema = T.StructType(
        [
            T.StructField("채수위치", T.StringType()),
            T.StructField("week_start_target", T.StringType()),
            T.StructField("p_alert_ge1_scenario", T.DoubleType()),
            T.StructField("p_alert_ge1_calibrated", T.DoubleType()),
            T.StructField("pred_stage", T.IntegerType()),
            T.StructField("pred_cyano_max_approx", T.DoubleType()),
            T.StructField("scenarios", T.ArrayType(ACTION_DOC)),
        ]
    )
    return spark.read.schema(schema).json(path, multiLine=not lines)
