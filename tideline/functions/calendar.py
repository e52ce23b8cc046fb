"""Calendar parts of a date column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.fixed_values import SEASON_NAMES


def season_code(month: Column) -> Column:
    """0 winter (Dec-Feb), 1 spring, 2 summer, 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


def season_label(month: Column, names: list[str] = SEASON_NAMES) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), season_code(month) + 1)


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    d = F.col(time)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day_of_year": F.dayofyear(d),
            "week_of_year": F.weekofyear(d),
            "season": season_code(F.month(d)),
            "summer": F.month(d).between(6, 8).cast("int"),
        }
    )


def between_dates(df: DataFrame, time: str, lo: str, hi: str) -> DataFrame:
    """Closed date range; reaches the scan as a pushed filter."""
    return df.where(F.col(time).between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def only_months(df: DataFrame, time: str, months: list[int]) -> DataFrame:
    return df.where(F.month(time).isin(*months))
