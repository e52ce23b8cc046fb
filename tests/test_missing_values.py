"""Missing values, unlisted classes and other edges that the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.functions.stages import label_from_code
from tideline.operators import aggregates as A
from tideline.operators import baselines, evaluation, events, quantiles, splits, thresholds
from tideline.operators.series import Series
from tideline.plans.panel_build import build_panel


def test_smoothing_takes_the_training_median(spark):
    rows = [("a", f"2020-01-{d:02d}", None if d in (5, 19) else 100.0) for d in range(1, 21)]
    d = spark.createDataFrame(rows, "key string, day string, v double").withColumn("day", F.to_date("day"))
    got = baselines.ses_baseline(d, Series(("key",), "day", daily=True), "v", [0.3, 0.9]).first()
    assert (got.n, got.holdout_n, got.mae_naive, got.mae_smooth) == (20, 3, 0.0, 0.0)


def test_persistence_leaves_out_missing_values(spark):
    rows = [(1, 1, None, 100.0, 90.0, None), (1, 1, 1, 50.0, 50.0, 50.0), (2, 1, 9, 80.0, None, 80.0)]
    d = spark.createDataFrame(rows, "y int, m int, prev int, v double, mv double, pv double")
    got = evaluation.compare_persistence(d, "y", "m", "prev", "v", "mv", "pv").first()
    assert got.mae_persistence == 0.0 and got.mae_model == 5.0
    assert got.accuracy_persistence == pytest.approx(1 / 3)
    assert 0 < got.r2_persistence < 1 and got.r2_model > 0.9


def test_a_missing_code_has_no_name(spark):
    d = spark.createDataFrame([(None,), (-1,), (7,)], "c int").select(label_from_code(F.col("c"), ["x", "y"]).alias("n"))
    assert [r.n for r in d.collect()] == [None, "x", "y"]


def test_an_empty_feature_becomes_zero(spark):
    d = spark.createDataFrame([(None, 1.0), (None, None), (None, 3.0)], "a double, b double")
    assert [tuple(r) for r in quantiles.median_impute(d, ["a", "b"]).collect()] == [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0)]


def test_null_groups_keep_their_row(spark):
    d = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 0), ("g", 5.0, 1), ("g", 2.0, 0)], "k string, v double, y int")
    assert {r.k: r.m for r in quantiles.exact_quantiles(d, "v", [0.5], by=["k"], names=["m"]).collect()} == {None: 2.0, "g": 3.5}
    assert {r.k: r.auc for r in evaluation.roc_auc(d, "y", "v", by=["k"]).collect()} == {None: 0.0, "g": 1.0}


def test_unlisted_classes_are_counted(spark):
    d = spark.createDataFrame([(3, 0), (0, 0), (None, 1)], "t int, p int")
    got = {(r.truth, r.pred): r.n for r in evaluation.confusion(d, "t", "p", [0, 1]).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 0, (3, 0): 1, (None, 1): 1}
    rows = [("a", f"2020-01-0{i + 1}", s) for i, s in enumerate([0, 3, 3, 1])]
    d = spark.createDataFrame(rows, "k string, day string, s int").withColumn("day", F.to_date("day"))
    steps = events.transitions(d, Series(("k",), "day", daily=True), "s", [0, 1, 2]).where("n > 0")
    assert {(r.prev, r.curr): r.n for r in steps.collect()} == {(0, 3): 1, (3, 3): 1, (3, 1): 1}
    d = spark.createDataFrame([(3, 0.0, 0.9), (2, 0.0, 0.9), (0, 0.0, 0.0)], "y int, p1 double, p2 double")
    assert thresholds.threshold_grid(d, "y", "p1", "p2", [0.5], [0.5]).first().accuracy == 1.0


def test_histogram_covers_all_values(spark):
    d = spark.createDataFrame([(-3.0,), (1.0,), (4.0,), (None,)], "v double")
    assert {r.bin_start: r.n for r in A.histogram(d, "v", 2).collect()} == {-4: 1, -2: 0, 0: 1, 2: 0, 4: 1}
    assert A.histogram(d.limit(0), "v", 2).count() == 0


def test_folds_with_one_large_day(spark):
    rows = [(k, f"2020-01-{day:02d}", i) for day, n in ((1, 3), (2, 90), (3, 7)) for i in range(n) for k in ("a",)]
    d = spark.createDataFrame(rows, "k string, day string, i int").withColumn("day", F.to_date("day"))
    got = splits.expanding_folds(d, Series(("k",), "day", ("i",)), 3).collect()
    place = {p: n for n, p in enumerate(sorted((r.day, r.k, r.i) for r in got))}
    assert len(got) == 100 and all(r.fold == place[(r.day, r.k, r.i)] // 25 for r in got)


def test_samples_of_one_day_follow_their_tie(spark):
    days = [("s", "2020-06-01", 1, 10.0, 1.0), ("s", "2020-06-01", 2, 20.0, None), ("s", "2020-06-01", 0, 5.0, 7.0), ("s", "2020-06-03", 1, 40.0, 3.0)]
    samples = spark.createDataFrame(days, f"`{X.SITE}` string, `{X.DATE}` string, no int, `{X.TOTAL}` double, `{X.PH}` double")
    samples = samples.withColumn(X.DATE, F.to_date(X.DATE))
    side = spark.createDataFrame([("2020-06-01", 1.0)], f"`{X.DATE}` string, rain double").withColumn(X.DATE, F.to_date(X.DATE))
    for parts in (1, 4):
        panel = build_panel(samples.repartition(parts), side, side.withColumnRenamed("rain", "flow"), ["no"], [X.TOTAL], [X.PH])
        first = panel.orderBy(X.DATE).first()
        assert first[X.PH] == 1.0 and first[X.TOTAL] == pytest.approx(20.0)
