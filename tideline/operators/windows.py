"""Look-back, look-ahead and run features over keyed series."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.series import Series, neighbour, over_series, seen, with_position

_AGG = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def _framed(c: Column, w, fn: str, lo: int, hi: int, need: int) -> Column:
    frame = w.rowsBetween(lo, hi)
    return F.when(F.count(c).over(frame) >= need, _AGG[fn](c).over(frame))


def lags(df: DataFrame, s: Series, values: Iterable[str], steps: Sequence[int]) -> DataFrame:
    """``<v>_lag<n>``: the value n rows earlier."""
    values = list(values)
    return over_series(
        df,
        s,
        lambda w, _: {f"{v}_lag{n}": F.lag(v, n).over(w) for v in values for n in steps},
        back=max(steps),
    )


def rolling(
    df: DataFrame,
    s: Series,
    specs: dict[str, tuple[str | Column, int, str]],
    strict: bool = False,
) -> DataFrame:
    """Trailing frames, ``{name: (value, n, mean|sum|max|min)}``.

    Lenient frames end at the row itself and take what is there.  Strict frames
    leave the row out and are null unless all n earlier values are present.
    """
    widest = max(n for _, n, _ in specs.values())

    def build(w, _):
        out = {}
        for name, (value, n, fn) in specs.items():
            c = F.col(value) if isinstance(value, str) else value
            out[name] = _framed(c, w, fn, -n, -1, n) if strict else _framed(c, w, fn, -n + 1, 0, 1)
        return out

    return over_series(df, s, build, back=widest)


def wow_delta(df: DataFrame, s: Series, values: Sequence[str], n: int = 7) -> DataFrame:
    """Mean of the last n rows minus the same mean n rows earlier."""

    def mean(w, _):
        return {f"__m_{v}": F.avg(v).over(w.rowsBetween(-n + 1, 0)) for v in values}

    def delta(w, _):
        return {f"wow_delta_{v}": F.col(f"__m_{v}") - F.lag(f"__m_{v}", n).over(w) for v in values}

    return over_series(df, s, [mean, delta], back=2 * n).drop(*[f"__m_{v}" for v in values])


def diff_n(df: DataFrame, s: Series, value: str, n: int, name: str | None = None) -> DataFrame:
    name = name or f"{value}_delta{n}"
    return over_series(df, s, lambda w, _: {name: F.col(value) - F.lag(value, n).over(w)}, back=n)


def rising_run(df: DataFrame, s: Series, value: str, n: int, name: str) -> DataFrame:
    """1 where each of the last n steps went up; a missing step counts as no."""

    def build(w, _):
        at = [F.lag(value, i).over(w) if i else F.col(value) for i in range(n + 1)]
        steps = [F.coalesce(at[i] > at[i + 1], F.lit(False)) for i in range(n)]
        rose = steps[0]
        for step in steps[1:]:
            rose = rose & step
        return {name: rose.cast("int")}

    return over_series(df, s, build, back=n)


def consecutive_true(df: DataFrame, s: Series, flag: str, name: str, n: int = 2) -> DataFrame:
    def build(w, _):
        both = F.coalesce(F.col(flag), F.lit(False))
        for i in range(1, n):
            both = both & F.coalesce(F.lag(flag, i).over(w), F.lit(False))
        return {name: both}

    return over_series(df, s, build, back=n - 1)


def streak(df: DataFrame, s: Series, holds: Column, name: str) -> DataFrame:
    """Length of the current run of rows where ``holds``; null breaks a run."""
    counted = with_position(df, s, "__row")
    broken = F.when(F.coalesce(holds, F.lit(False)), None).otherwise(F.col("__row"))
    marked = seen(counted, s, {"__break": broken})
    length = F.col("__row") - F.coalesce(F.col("__break"), F.lit(-1))
    return marked.withColumn(name, length.cast("int")).drop("__row", "__break")


def clipped_sum(
    df: DataFrame,
    s: Series,
    value: str,
    base: float,
    n: int,
    name: str,
    subtract: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Degree-day style sums: values floored at ``base``, base taken off or kept.

    A missing value stays missing (``greatest`` alone would turn it into the base).
    """
    floored = F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(float(base))))
    term = floored - F.lit(float(base)) if subtract else floored
    return rolling(df, s, {name: (term, n, "sum")}, strict=strict)


def stress_indices(df: DataFrame, s: Series, heat: str, rain: str, base: float = 28.0) -> DataFrame:
    """Heat stress over 7 and 14 rows, water load, their product form and heat run."""
    over = F.when(F.col(heat).isNotNull(), F.greatest(F.col(heat), F.lit(base)) - F.lit(base))
    out = rolling(
        df,
        s,
        {
            "hsi_14": (over, 14, "sum"),
            "hsi_7": (over, 7, "sum"),
            "__rain7": (rain, 7, "sum"),
            "__rain14": (rain, 14, "sum"),
        },
    )
    out = (
        out.withColumn("hli_7", F.col("__rain7") / 700)
        .withColumn("hli_14", F.col("__rain14") / 1400)
        .withColumn("csi", F.col("hsi_14") * (1 + F.col("hli_7")))
        .drop("__rain7", "__rain14")
    )
    return streak(out, s, F.col(heat) >= base, "heat_streak")


def lead_label(df: DataFrame, s: Series, value: str, n: int, name: str) -> DataFrame:
    return over_series(df, s, lambda w, _: {name: F.lead(value, n).over(w)}, ahead=n)


def frame_max(df: DataFrame, s: Series, value: str, lo: int, hi: int, name: str) -> DataFrame:
    """Max over the row frame [lo, hi]; (1, 7) is the next seven rows."""
    return over_series(
        df,
        s,
        lambda w, _: {name: F.max(value).over(w.rowsBetween(lo, hi))},
        back=max(-lo, 0),
        ahead=max(hi, 0),
    )


def lookback(
    df: DataFrame,
    s: Series,
    values: Sequence[str],
    periods: int = 4,
    short: Sequence[str] = (),
    prefix: str = "lw",
    labels: dict[str, Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Summary of the periods before each row: mean, population sd, slope.

    ``short`` columns also get their two-period mean and last value; ``carry``
    columns get a ``persist_<v>`` copy of the previous period.  Rows without
    ``periods`` predecessors are dropped.  One window serves every feature.
    """
    tag = f"{prefix}{periods}"

    def build(w, pos):
        past = w.rowsBetween(-periods, -1)
        two = w.rowsBetween(-2, -1)
        out: dict[str, Column] = {"__enough": pos >= max(periods, 2)}
        for v in values:
            out[f"{tag}_mean_{v}"] = F.avg(v).over(past)
            out[f"{tag}_std_{v}"] = F.stddev_pop(v).over(past)
            out[f"{tag}_slope_{v}"] = F.lag(v, 1).over(w) - F.lag(v, periods).over(w)
        for v in short:
            out[f"lw2_mean_{v}"] = F.avg(v).over(two)
            out[f"lw1_{v}"] = F.lag(v, 1).over(w)
        for v in carry:
            out[f"persist_{v}"] = F.lag(v, 1).over(w)
        return out

    out = over_series(df, s, build, back=max(periods, 2)).where("__enough").drop("__enough")
    return out.withColumns(labels) if labels else out


def persistence(df: DataFrame, s: Series, values: dict[str, str], skip: int = 0) -> DataFrame:
    """Previous period's value as the forecast, for rows past the first ``skip``."""
    if not skip:
        return neighbour(df, s, values, step=-1)
    out = over_series(
        df,
        s,
        lambda w, pos: {"__ok": pos >= skip, **{n: F.lag(v, 1).over(w) for n, v in values.items()}},
        back=1,
    )
    return out.where("__ok").drop("__ok")


def sequences(df: DataFrame, s: Series, values: Sequence[str], n: int, name: str = "sequence") -> DataFrame:
    """The n rows before each row as an n x F array; shorter histories are dropped."""
    row = F.array(*[F.col(v).cast("double") for v in values])
    out = over_series(
        df, s, lambda w, _: {name: F.collect_list(row).over(w.rowsBetween(-n, -1))}, back=n
    )
    return out.where(F.size(name) == n)
