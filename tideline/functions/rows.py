"""Row-wise expressions: sums, shares, bins, differences, transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_sum(cols: Sequence[str]) -> Column:
    """Null-skipping sum; all missing gives 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def shares(df: DataFrame, cols: Sequence[str], suffix: str = "_dom", eps: float = 1e-6) -> DataFrame:
    total = row_sum(cols) + F.lit(eps)
    return df.withColumns({f"{c}{suffix}": F.col(c) / total for c in cols})


def argmax_label(cols: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Label of the largest column; the first one wins a tie, nulls are skipped."""
    top = F.greatest(*[F.col(c) for c in cols])
    return F.coalesce(*[F.when(F.col(c) == top, F.lit(n)) for c, n in zip(cols, labels or cols)])


def bin_by(v: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Interval label; outside all intervals is null.

    Left-closed by default, so the top edge is outside; ``right`` closes the right side.
    """
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (v > lo) & (v <= hi) if right else (v >= lo) & (v < hi)
        out = F.when(inside, label).otherwise(out)
    return out


def fill_from(first: Column, *rest: Column) -> Column:
    return F.coalesce(first, *rest)


def floor_at(v: Column, low: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(v, F.lit(float(low))))


def to_log(v: Column) -> Column:
    return F.log1p(floor_at(v, 0.0))


def from_log(p: Column) -> Column:
    return floor_at(F.expm1(p), 0.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here, as it is in the source files."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric})


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * c / F.lit(period)
    return F.sin(angle), F.cos(angle)


def risk_score(spec: dict[str, Column], zero_is_missing: bool = False) -> Column:
    """Weighted 0-100 score of heat, wind, storage and flow terms.

    ``spec`` gives air, water, wind, storage, inflow7, outflow and heat columns.
    By default any missing input leaves the score empty; ``zero_is_missing``
    replaces missing and zero inputs by their neutral value instead.
    """
    neutral = {"air": 0.0, "water": 0.0, "wind": 2.0, "storage": 50.0, "inflow7": 0.0, "outflow": 0.0, "heat": 0.0}
    x = {
        k: F.when(v.isNull() | (v == 0), F.lit(neutral[k])).otherwise(v) if zero_is_missing else v
        for k, v in spec.items()
    }
    score = (
        0.25 * floor_at(x["air"] - 25, 0)
        + 0.20 * floor_at(x["water"] - 20, 0)
        + 0.15 * floor_at(2 - x["wind"], 0)
        + 0.15 * floor_at((x["storage"] - 40) / 40, 0)
        + 0.15 * F.log1p(x["inflow7"]) / 10
        - 0.10 * F.log1p(x["outflow"]) / 10
        + 0.10 * x["heat"] / 50
    )
    scaled = score * 100 / 3.5
    return F.when(scaled.isNotNull(), F.bround(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)), 1))
