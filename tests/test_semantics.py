"""Literal tables for every place where missing values and edges could go wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import rows as R
from tideline.functions import stages as St
from tideline.operators import events as E
from tideline.operators import resample as Rs
from tideline.operators import splits as L
from tideline.operators import windows as Wn
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.series import Series

D0 = dt.date(2024, 1, 1)
DAILY = Series(("k",), "d", daily=True)
SPLIT = Series(("k",), "d", ("i",), bucket_days=2, block_rows=4)
BOTH = pytest.mark.parametrize("s", [DAILY, SPLIT], ids=["plain", "split"])


def series(spark, values, col="v", kind="double"):
    cast = float if kind == "double" else int
    rows = [("a", D0 + dt.timedelta(days=i), i, None if v is None else cast(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, d date, i int, {col} {kind}")


def column(df, name):
    return [r[name] for r in df.orderBy("k", "d").collect()]


@BOTH
def test_interpolation_and_limit(spark, s):
    d = series(spark, [None, 1.0, None, None, 4.0, None, None])
    assert column(Rs.interpolate_linear(d, s, ["v"]), "v") == [None, 1, 2, 3, 4, 4, 4]
    assert column(Rs.interpolate_linear(d, s, ["v"], limit=1), "v") == [None, 1, 2, None, 4, 4, None]
    assert column(Rs.fill_edges(d, s, ["v"]), "v") == [1, 1, 4, 4, 4, 4, 4]
    assert column(Rs.ffill_zero(d, s, ["v"]), "v") == [0, 1, 1, 1, 4, 4, 4]
    assert column(Rs.fill_chain(d, s, ["v"]), "v") == [1, 1, 2, 3, 4, 4, 4]


@BOTH
def test_fill_chain_of_nothing_is_zero(spark, s):
    assert column(Rs.fill_chain(series(spark, [None, None, None]), s, ["v"]), "v") == [0, 0, 0]


@BOTH
def test_framed_max_documented_and_shifted(spark, s):
    d = series(spark, list(range(1, 13)), kind="int")
    assert column(Wn.frame_max(d, s, "v", -5, 1, "m"), "m") == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    assert column(Wn.frame_max(d, s, "v", 1, 7, "m"), "m") == [8, 9, 10, 11, 12, 12, 12, 12, 12, 12, 12, None]


@BOTH
def test_strict_roll_needs_all_rows(spark, s):
    d = series(spark, [1.0, 2, None, 4, 5, 6, 7])
    out = Wn.rolling(d, s, {"m": ("v", 3, "mean")}, strict=True)
    assert column(out, "m") == [None, None, None, None, None, None, 5]


@BOTH
def test_streak_and_null_reset(spark, s):
    d = series(spark, [28.0, 29, None, 30, 31, 27, 28])
    assert column(Wn.streak(d, s, F.col("v") >= 28, "n"), "n") == [1, 2, 0, 1, 2, 0, 1]


@BOTH
def test_two_onset_definitions(spark, s):
    d = series(spark, [1, 0, 1, 1, 0, 1], "f", "int")
    assert column(E.onset(d, s, "f", "o"), "o") == [1, 0, 1, 0, 0, 1]
    assert column(E.onset(d, s, "f", "o", default=None), "o") == [0, 0, 1, 0, 0, 1]


@BOTH
def test_episodes_open_and_closed(spark, s):
    d = series(spark, [0, 2, 2, 0, 2, 2], "st", "int")
    rows = E.episodes(d, s, F.col("st") >= 2).orderBy("start").collect()
    day = lambda n: D0 + dt.timedelta(days=n - 1)
    assert [(r["start"], r["end"], r["length"], r["open"]) for r in rows] == [
        (day(2), day(3), 2, False),
        (day(5), day(6), 2, True),
    ]


@BOTH
def test_unknown_state_keeps_an_episode_open(spark, s):
    d = series(spark, [2, None, 2, 0], "st", "int")
    rows = E.episodes(d, s, F.col("st") >= 2).collect()
    assert [(r["start"], r["length"]) for r in rows] == [(D0, 3)]


@BOTH
def test_detection_takes_latest_match_within_rows(spark, s):
    d = series(spark, [0, 0, 0, 0, 0, 2], "st", "int").withColumn("hit", F.col("i").isin(1, 3))
    late = E.episodes(d, s, F.col("st") >= 2, detect=F.col("hit"), window=4).first()
    early = E.episodes(d, s, F.col("st") >= 2, detect=F.col("hit"), window=5, earliest=True).first()
    missed = E.episodes(d, s, F.col("st") >= 2, detect=F.col("hit"), window=2).first()
    assert (late["lead"], early["lead"], missed["lead"], missed["detected"]) == (2, 4, None, False)


@BOTH
def test_rising_run_and_missing_steps(spark, s):
    d = series(spark, [1.0, 2, 3, 4, None, 5, 6, 7, 8])
    assert column(Wn.rising_run(d, s, "v", 3, "r"), "r") == [0, 0, 0, 1, 0, 0, 0, 0, 1]


@BOTH
def test_clipped_sum_keeps_missing_missing(spark, s):
    d = series(spark, [None, 30.0, 20.0])
    out = Wn.clipped_sum(d, s, "v", 28.0, 2, "n")
    assert column(out, "n") == [None, 2.0, 2.0]


@BOTH
def test_lookback_matches_hand_values(spark, s):
    d = series(spark, [1.0, 2, 4, 8, 16])
    rows = Wn.lookback(d, s, ["v"], 3, short=["v"], carry=["v"]).orderBy("d").collect()
    assert [r["lw3_mean_v"] for r in rows] == [pytest.approx(7 / 3), pytest.approx(14 / 3)]
    assert [r["lw3_slope_v"] for r in rows] == [3, 6]
    assert [r["lw2_mean_v"] for r in rows] == [3, 6]
    assert [r["persist_v"] for r in rows] == [4, 8]
    assert rows[0]["lw3_std_v"] == pytest.approx(1.247219, abs=1e-6)


def test_growth_expansion(spark):
    rows = [("a", D0, 0, 1.0), ("a", D0 + dt.timedelta(days=4), 1, 16.0), ("a", D0 + dt.timedelta(days=4), 2, 3.0)]
    d = spark.createDataFrame(rows, "k string, d date, i int, v double")
    out = Rs.expand_growth(d, Series(("k",), "d", ("i",)), ["v"]).orderBy("d").collect()
    # the two samples of the last day span nothing: only the later one is kept
    assert [r["d"] for r in out] == [D0 + dt.timedelta(days=i) for i in range(5)]
    assert [r["v"] for r in out[:4]] == [pytest.approx(x, abs=1e-4) for x in (1, 2, 4, 8)]
    assert out[4]["v"] == 3.0


def test_week_start_and_empty_sum(spark):
    rows = [("a", dt.date(2024, 1, 7), None), ("a", dt.date(2024, 1, 8), 2.0)]
    d = spark.createDataFrame(rows, "k string, d date, v double")
    out = Rs.to_weekly(d, ["k"], "d", {"s": ("v", "sum"), "m": ("v", "mean")}).orderBy("week_start").collect()
    assert [tuple(r)[1:] for r in out] == [(dt.date(2024, 1, 1), 0.0, None), (dt.date(2024, 1, 8), 2.0, 2.0)]


def test_bins_and_edges(spark):
    d = spark.createDataFrame([(0.0,), (40.0,), (110.0,), (-1.0,)], "v double")
    got = [r[0] for r in d.select(R.bin_by(F.col("v"), [0, 40, 60, 80, 110], ["<40", "40-60", "60-80", ">80"])).collect()]
    assert got == ["<40", "40-60", None, None]


def test_holdout_cut(spark):
    rows = [(D0 + dt.timedelta(days=i),) for i in range(20)]
    d = spark.createDataFrame(rows + rows, "d date")
    assert L.holdout_cut(d, "d", 0.15).first()["cut"] == D0 + dt.timedelta(days=16)


def test_quantile_is_linear(spark):
    d = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    row = exact_quantiles(d, "v", [0.33, 0.66]).first()
    assert row == (pytest.approx(1.99), pytest.approx(2.98))


def test_stage_codes(spark):
    d = spark.createDataFrame([(None, None), (999.0, " 관심 "), (1e4, "조류 대발생"), (1e6, "?")], "v double, s string")
    rows = d.select(St.stage_from_value(F.col("v")), St.stage_from_label(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0, 1), (2, 3), (3, 0)]


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert R.nan_to_null(d).agg(F.max("v")).first()[0] == 1.0


def test_risk_score_modes(spark):
    d = spark.createDataFrame([(30.0, 24.0, 0.0, 70.0, 100.0, 50.0, 10.0), (30.0, None, 1.0, 70.0, 100.0, 50.0, 10.0)],
                              "air double, water double, wind double, storage double, inflow7 double, outflow double, heat double")
    spec = {c: F.col(c) for c in d.columns}
    plain = [r[0] for r in d.select(R.risk_score(spec)).collect()]
    neutral = [r[0] for r in d.select(R.risk_score(spec, zero_is_missing=True)).collect()]
    assert plain[1] is None and neutral[1] is not None
    assert plain[0] > neutral[0]  # a calm of 0 counts in the plain mode only


def test_half_even_only_where_asked(spark):
    row = spark.range(1).select(F.round(F.lit(2.25), 1), F.bround(F.lit(2.25), 1)).first()
    assert tuple(row) == (2.3, 2.2)


def test_clamp_keeps_null(spark):
    d = spark.createDataFrame([(None,), (5,), (-1,)], "v int")
    assert [r[0] for r in d.select(St.clamp(F.col("v"), 0, 3)).collect()] == [None, 3, 0]
