"""Headers, required columns, lenient typing and feature lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.fixed_values import REQUIRED


def normalize_headers(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Trim headers, drop line breaks and repeated blanks, then rename.

    A dot would read as a struct access in expressions, so it becomes an underscore.
    """
    clean = df.toDF(*[" ".join(c.split()).replace(".", "_") for c in df.columns])
    return clean.withColumnsRenamed(renames or {})


def require_columns(df: DataFrame, cols: Iterable[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coerce_types(df: DataFrame, numbers: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """Text to double or date; what cannot be read, and NaN, becomes null."""
    new = {}
    for c in numbers:
        if c in df.columns:
            number = F.col(c).try_cast("double")
            new[c] = F.when(~F.isnan(number), number)
    for c in dates:
        if c in df.columns:
            new[c] = F.col(c).try_cast("date")
    return df.withColumns(new) if new else df


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_optional(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def select_features(
    df: DataFrame,
    prefixes: Sequence[str] = (),
    exclude: Iterable[str] = (),
    without: Sequence[str] = (),
    containing: Sequence[str] = (),
) -> list[str]:
    """Sorted names of numeric and boolean columns.

    ``prefixes`` keeps names that start so, ``containing`` names with any of these
    parts, ``without`` drops names with any of these parts, ``exclude`` exact names.
    """
    skip = set(exclude)
    names = []
    for field in df.schema:
        kind = field.dataType
        if field.name in skip or not isinstance(kind, (T.NumericType, T.BooleanType)):
            continue
        if prefixes and not field.name.startswith(tuple(prefixes)):
            continue
        if containing and not any(part in field.name for part in containing):
            continue
        if any(part in field.name for part in without):
            continue
        names.append(field.name)
    return sorted(names)
