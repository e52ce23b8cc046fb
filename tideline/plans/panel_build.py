"""Samples, weather and dam records to one site-by-day panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.operators.joins import attach, attach_daily
from tideline.operators.resample import average_over, expand_growth, fill_edges, interpolate_linear
from tideline.operators.series import Series

QUALITY = [X.WATER_TEMP, X.PH, X.DO, X.TURBIDITY, X.CHL_A]


def build_panel(
    samples: DataFrame,
    weather: DataFrame,
    dam: DataFrame,
    tie: Sequence[str] = (),
    counts: Sequence[str] = (X.TOTAL, *X.SPECIES),
    quality: Sequence[str] = tuple(QUALITY),
) -> DataFrame:
    """Daily panel: counts grown between samples, quality interpolated, side series attached.

    ``samples`` holds one row per site and sample, ``weather`` one per station and
    day, ``dam`` one per day.  ``tie`` orders samples of one site and day: the last that has a
    value counts.  Without it, the values of all columns in alphabetical order do.
    """
    sparse = Series((X.SITE,), X.DATE, tuple(tie))
    daily = expand_growth(samples, sparse, list(counts))
    if quality:
        if not tie:  # else which of two samples of a day counts would depend on the order of rows
            tie = sorted(c for c in samples.columns if c not in (X.SITE, X.DATE))
        last = F.struct(*tie)
        own = samples.groupBy(X.SITE, X.DATE).agg(
            *[F.max_by(q, F.when(F.col(q).isNotNull(), last)).alias(q) for q in quality]
        )
        daily = attach(daily, own, [X.SITE, X.DATE])
        # Growth yields one row per site and day.
        series = Series((X.SITE,), X.DATE, daily=True)
        daily = fill_edges(interpolate_linear(daily, series, list(quality)), series, list(quality))
    stations = [c for c, t in weather.dtypes if t == "double"]
    daily = attach_daily(daily, average_over(weather, [X.DATE], stations), X.DATE)
    rain = [c for c in (X.RAIN,) if c in stations]
    daily = daily.na.fill(0.0, rain)
    per_day = [c for c, t in dam.dtypes if t == "double"]
    return attach_daily(daily, average_over(dam, [X.DATE], per_day), X.DATE)
