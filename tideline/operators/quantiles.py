"""Exact order statistics that never sit in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer.  Here a sketch only proposes pivots close to the wanted
ranks; counts per pivot range then say exactly which ranges hold them, and only
those few rows are ranked.  The sketch's error moves work, never the answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_of(v: Column, pivots: Column, n: int) -> Column:
    """How many of the n pivots a value reaches, as plain comparisons."""
    return reduce(add, [(v >= F.get(pivots, F.lit(i))).cast("int") for i in range(n)])


def exact_quantiles(
    df: DataFrame,
    value: str,
    qs: Sequence[float] | Sequence[Column],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    accuracy: int = 10_000,
    expect: Sequence[float] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group.

    A share in ``qs`` may be a column over ``n``, the group's count of values;
    ``expect`` then says where it is likely to fall (a guess only costs time).
    """
    by = list(by)
    names = list(names or [f"q{round(q * 100)}" for q in qs])
    shares = [q if isinstance(q, Column) else F.lit(float(q)) for q in qs]
    slack = 3.0 / accuracy
    fixed = list(expect) if expect is not None else [q for q in qs if not isinstance(q, Column)]
    probes = sorted({min(max(q + d, 0.0), 1.0) for q in fixed for d in (-slack, slack)}) or [
        i / 64 for i in range(1, 64)
    ]
    v = F.col(value).cast("double")
    # Fields of a struct compare null-safe, so a null group is a group like any other.
    group, by = by, ["__group"] if by else []
    values = df.select(*[F.struct(*group).alias(g) for g in by], v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    sketch = values.groupBy(*by).agg(
        F.percentile_approx("__v", probes, accuracy).alias("__pivots"), F.count(F.lit(1)).alias("n")
    )
    # One row per group: joined by the group, or as a single row to every task.
    pivots = sketch.select(*by, "__pivots")
    placed = (values.join(pivots, by) if by else values.crossJoin(F.broadcast(pivots))).withColumn(
        "__r", _range_of(F.col("__v"), F.col("__pivots"), len(probes))
    )
    counted = placed.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = counted.select(
        *by,
        "__r",
        "__c",
        F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__start"),
        F.sum("__c").over(whole).alias("n"),
    )
    # The two ranks each share lies between; at most two ranges per share and group hold one.
    spots = F.array(*[(F.col("n") - 1) * q for q in shares])
    ranks = F.array_distinct(
        F.flatten(F.transform(spots, lambda a: F.array(F.floor(a), F.least(F.floor(a) + 1, F.col("n") - 1))))
    )
    holds = F.exists(ranks, lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c")))
    targets = starts.where(holds).select(*by, "__r", "__start", "n")
    # Only rows of those ranges are kept, collapsed to distinct values and ranked.
    near = placed.select(*by, "__r", "__v").join(F.broadcast(targets) if not by else targets, [*by, "__r"])
    ties = near.groupBy(*by, "__r", "__start", "n", "__v").agg(F.count(F.lit(1)).alias("__t"))
    run = Window.partitionBy(*by, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.withColumn("__end", F.col("__start") + F.sum("__t").over(run)).withColumn("__ranks", ranks)
    covered = F.filter("__ranks", lambda r: (r >= F.col("__end") - F.col("__t")) & (r < F.col("__end")))
    hits = ranked.select(*by, spots.alias("__at"), "__v", F.explode(covered).alias("__rank"))
    picked = hits.groupBy(*by).agg(
        F.first("__at").alias("__at"),
        F.map_from_entries(F.collect_set(F.struct("__rank", "__v"))).alias("__by_rank"),
    )
    out = []
    for i, name in enumerate(names):
        a = F.get("__at", F.lit(i))
        lo = F.element_at("__by_rank", F.floor(a))
        hi = F.coalesce(F.element_at("__by_rank", F.floor(a) + 1), lo)
        out.append((lo + (hi - lo) * (a - F.floor(a))).alias(name))
    return picked.select(*[F.col(by[0]).getField(g).alias(g) for g in group], *out)


def count_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Exact quantiles of a value with few distinct values (day counts, lags).

    ``percentile`` keeps one counter per distinct value, which a calendar bounds.
    """
    return df.groupBy(*by).agg(*[F.percentile(value, float(q)).alias(n) for q, n in zip(qs, names)])


def quantile_with_fallback(
    df: DataFrame, value: str, q: float, fallback_q: float, default: float, name: str
) -> DataFrame:
    """The q-quantile; if that is 0, ``fallback_q`` of the positive values, else ``default``."""
    first = exact_quantiles(df, value, [q], names=["__q"])
    positive = exact_quantiles(df.where(F.col(value) > 0), value, [fallback_q], names=["__p"])
    both = first.join(F.broadcast(positive), how="left")
    chosen = F.when(F.col("__q") == 0, F.coalesce(F.col("__p"), F.lit(float(default)))).otherwise(F.col("__q"))
    return both.select(chosen.alias(name))


def median_impute(df: DataFrame, values: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Infinite and NaN to null, then null to the column's exact median; 0 where there is no value.

    ``fit_on`` limits the rows the medians are taken from (the training part);
    without it they come from all rows.  The medians are one row of numbers; they are
    fetched and become literals, so later stages do not compute them again.  Finding
    them reads the table three times: store a table that is costly to compute first.
    """
    clean = df.withColumns(
        {v: F.when(F.abs(v).isin(float("inf")) | F.isnan(v), None).otherwise(F.col(v)) for v in values}
    )
    base = clean if fit_on is None else clean.where(fit_on)
    known = {v: m for v, m in column_medians(base, values).items() if m is not None}
    return clean.withColumns({v: F.coalesce(F.col(v).cast("double"), F.lit(known.get(v, 0.0))) for v in values})


def column_medians(df: DataFrame, values: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column, None without values."""
    return {c: found[0] for c, found in wide_quantiles(df, values, [0.5]).items()}


#: Values of a column that one aggregate may lay out in order; a wider gap between pivots is cut again.
AT_ONCE = 20_000
#: Share of the rows that the first sketch is made of.
SKETCHED = 1 / 16


def wide_quantiles(
    df: DataFrame, values: Sequence[str], qs: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of many columns side by side; nulls and NaN do not count.

    Every pass is one aggregate of one row: a sketch of some rows proposes pivots on both sides of each wanted rank, counters
    of values below and up to each pivot say whether the rank is a pivot itself or between which two it
    lies, and the few values between them are laid out. Rows are neither copied per column nor shuffled; only the
    pivots and those few values come to the driver. A gap that still holds more than ``AT_ONCE`` values gets pivots of its own.
    """
    cols = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in values}
    near = lambda f, slack: [min(max(f + d, 0.0), 1.0) for d in (-slack, slack)]
    probes = sorted({x for q in qs for x in near(q, 0.01)})
    some = df.sample(SKETCHED, seed=42)  # a sketch of few rows is as good a proposal
    first = some.agg(*[F.percentile_approx(v, probes, accuracy).alias(f"p{i}") for i, v in enumerate(cols.values())]).first()
    pivots = {c: sorted(set(first[f"p{i}"] or [])) for i, c in enumerate(cols)}
    sizes: dict[str, int] = {}
    ranks: dict[str, set[int]] = {}
    # What is known of a column: value -> (values below it, values up to it).
    known: dict[str, dict[float, tuple[int, int]]] = {c: {} for c in cols}
    at: dict[str, dict[int, float]] = {c: {} for c in cols}

    while True:
        asked = [(c, p) for c in cols for p in pivots[c] if p not in known[c]]
        counters = [x for c, p in asked for x in (F.count_if(cols[c] < p), F.count_if(cols[c] <= p))]
        counters += [F.count(v) for v in cols.values()] if not sizes else []
        if counters:
            row = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(counters)]).first()
            for i, (c, p) in enumerate(asked):
                known[c][p] = (row[2 * i], row[2 * i + 1])
            if not sizes:
                sizes = dict(zip(cols, row[2 * len(asked) :]))
                ranks = {c: {r for q in qs for r in _ranks(n, q)} for c, n in sizes.items()}
        gaps = {}
        for c in cols:
            for r in ranks[c] - at[c].keys():
                below = [p for p, (_, upto) in known[c].items() if upto <= r]
                above = [p for p, (less, _) in known[c].items() if less > r]
                inside = [p for p, (less, upto) in known[c].items() if less <= r < upto]
                if inside:
                    at[c][r] = inside[0]
                    continue
                lo, hi = max(below, default=None), min(above, default=None)
                start = known[c][lo][1] if lo is not None else 0
                end = known[c][hi][0] if hi is not None else sizes[c]
                gaps.setdefault((c, lo, hi, start, end), []).append(r)
        if not gaps:
            return {c: [_between(at[c], sizes[c], q) for q in qs] for c in cols}

        aggs = []
        for (c, lo, hi, start, end), wanted in gaps.items():
            v = cols[c]
            held = F.lit(True) if lo is None else v > lo
            held = held if hi is None else held & (v < hi)
            own = F.when(held, v)
            if end - start <= AT_ONCE:
                aggs.append(F.array_sort(F.collect_list(own)))
            else:
                shares = sorted({x for r in wanted for x in near((r - start) / (end - start), 3.0 / accuracy)})
                aggs.append(F.percentile_approx(own, shares, accuracy))
        row = df.agg(*[a.alias(f"g{i}") for i, a in enumerate(aggs)]).first()
        pivots = {c: [] for c in cols}
        for i, ((c, lo, hi, start, end), wanted) in enumerate(gaps.items()):
            if end - start <= AT_ONCE:
                at[c].update({r: row[i][r - start] for r in wanted})
            else:
                pivots[c] += row[i]


def _ranks(n: int, q: float) -> set[int]:
    low = math.floor((n - 1) * q)
    return {low, min(low + 1, n - 1)} if n else set()


def _between(at: dict[int, float], n: int, q: float) -> float | None:
    if not n:
        return None
    place = (n - 1) * q
    low = math.floor(place)
    a, b = at[low], at[min(low + 1, n - 1)]
    return a + (b - a) * (place - low)


def column_quantile_rows(df: DataFrame, values: Sequence[str], qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row per column that has values, with its exact quantiles."""
    found = wide_quantiles(df, values, qs)
    rows = [(c, *found[c]) for c in values if found[c] and found[c][0] is not None]
    return df.sparkSession.createDataFrame(rows, "column_name string, " + ", ".join(f"{n} double" for n in names))
