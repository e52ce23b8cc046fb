"""The split layout must give what a plain window per key gives, hot keys included."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import aggregates as A
from tideline.operators import events as E
from tideline.operators import resample as Rs
from tideline.operators import splits as L
from tideline.operators import windows as Wn
from tideline.operators.series import Series, measured, neighbour, seen, with_position

KEYS, TIME, TIE = ("k",), "d", ("i",)
# One bucket over all time is the plain window; the others cut keys into many parts.
WHOLE = Series(KEYS, TIME, TIE, bucket_days=1_000_000, block_rows=1_000_000)
CUTS = [
    Series(KEYS, TIME, TIE, bucket_days=30, block_rows=20),
    Series(KEYS, TIME, TIE, bucket_days=1, tie_width=5, block_rows=16),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if i % 2 else rng.choice("abcdefgh")  # one key holds half of all rows
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 0, 1, rng.randrange(120)]))
        data.append((key, day, i, None if rng.random() < 0.3 else float(rng.randrange(100))))
    return spark.createDataFrame(data, "k string, d date, i int, v double").cache()


def same(make, rows):
    want = sorted(map(tuple, make(rows, WHOLE).collect()), key=repr)
    for s in CUTS:
        assert sorted(map(tuple, make(rows, s).collect()), key=repr) == want, s


CASES = {
    "position": lambda d, s: with_position(d, s, "p"),
    "lags": lambda d, s: Wn.lags(d, s, ["v"], [1, 3, 14]),
    "lead": lambda d, s: Wn.lead_label(d, s, "v", 7, "t"),
    "rolling": lambda d, s: Wn.rolling(d, s, {"a": ("v", 7, "sum"), "b": ("v", 14, "max")}),
    "strict": lambda d, s: Wn.rolling(d, s, {"a": ("v", 3, "sum")}, strict=True),
    "wow": lambda d, s: Wn.wow_delta(d.withColumn("v", F.floor("v") * 420.0), s, ["v"], 7).withColumn("wow_delta_v", F.round("wow_delta_v", 6)),
    "frame": lambda d, s: Wn.frame_max(d, s, "v", -5, 7, "m"),
    "rising": lambda d, s: Wn.rising_run(d, s, "v", 3, "r"),
    "consecutive": lambda d, s: Wn.consecutive_true(d.withColumn("f", F.col("v") > 50), s, "f", "c"),
    "streak": lambda d, s: Wn.streak(d, s, F.col("v") > 30, "n"),
    "lookback": lambda d, s: Wn.lookback(d, s, ["v"], 4, short=["v"]).drop("lw4_std_v").withColumns({c: F.round(c, 6) for c in ["lw4_mean_v", "lw2_mean_v"]}),
    "sequences": lambda d, s: Wn.sequences(d, s, ["i"], 5),
    "neighbour": lambda d, s: neighbour(neighbour(d, s, {"p": "v", "pt": "d"}), s, {"n": "v"}, step=1),
    "seen": lambda d, s: seen(seen(d, s, {"a": F.col("v")}), s, {"b": F.col("v")}, forward=True, inclusive=False),
    "interpolate": lambda d, s: Rs.interpolate_linear(d, s, ["v"], limit=2).withColumn("v", F.round("v", 6)),
    "growth": lambda d, s: Rs.expand_growth(d.na.fill(3.0), s, ["v"]).withColumn("v", F.round("v", 6)),
    "onset": lambda d, s: E.onset(d.withColumn("f", (F.col("v") > 50).cast("int")), s, "f", "o"),
    "episodes": lambda d, s: E.episodes(d, s, F.col("v") > 40, detect=F.col("v") > 80, window=6),
    "transitions": lambda d, s: E.transitions(d.withColumn("st", F.floor(F.col("v") / 40).cast("int")), s, "st", [0, 1, 2]),
    "gap": lambda d, s: A.median_gap(d, s),
    "tail": lambda d, s: L.tail_split(d, s, 0.2),
    "folds": lambda d, s: L.expanding_folds(d, s, 3),
    "lag_corr": lambda d, s: A.lag_correlation(d, s, "v", "i", [0, 2]).withColumn("r", F.round("r", 6)),
}


@pytest.mark.parametrize("name", CASES)
def test_split_equals_plain(rows, name):
    same(CASES[name], rows)


def test_plain_layout_is_chosen_by_looking(spark, rows):
    assert not measured(rows, ["k"], "d").daily
    one = rows.groupBy("k", "d").agg(F.sum("v").alias("v"))
    assert measured(one, ["k"], "d").daily


def test_daily_layout_equals_split(rows):
    one = rows.groupBy("k", "d").agg(F.sum("v").alias("v")).withColumn("i", F.lit(0)).select("k", "d", "i", "v")
    plain = Series(KEYS, TIME, daily=True)
    for name in ("lags", "rolling", "streak", "neighbour", "seen", "interpolate", "episodes", "position"):
        want = sorted(map(tuple, CASES[name](one, plain).collect()), key=repr)
        assert sorted(map(tuple, CASES[name](one, CUTS[0]).collect()), key=repr) == want, name


def test_growth_row_count(rows):
    out = Rs.expand_growth(rows.na.fill(1.0), CUTS[0], ["v"])
    span = rows.groupBy("k").agg((F.datediff(F.max("d"), F.min("d")) + 1).alias("n")).agg(F.sum("n")).first()[0]
    assert out.count() == span
    assert out.groupBy("k", "d").count().where("count > 1").count() == 0
