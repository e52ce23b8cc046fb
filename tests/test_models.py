"""Model operators on data whose structure is known."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import evaluation as V
from tideline.operators import importance as I
from tideline.operators import models as M
from tideline.operators.series import Series


@pytest.fixture(scope="module")
def rows(spark):
    """Stage 0, 1, 2 from a; b is noise; every third row is a test row."""
    i = F.col("id")
    a = F.pmod(i * 37, F.lit(101)) / 100
    b = F.pmod(i * 53, F.lit(97)) / 96
    d = spark.range(900).select(
        i, F.concat(F.lit("k"), i % 3).alias("key"), F.date_add(F.lit("2020-01-01").cast("date"), (i / 3).cast("int")).alias("day"), a.alias("a"), b.alias("b")
    )
    stage = F.when(F.col("a") > 0.7, 2.0).when(F.col("a") > 0.4, 1.0).otherwise(0.0)
    d = d.withColumns({"stage": stage, "y": 3 * F.col("a") + 0.2 * F.sin(i), "alert": (F.col("a") > 0.4).cast("double"), "w": F.lit(1.0)})
    return d.withColumn("split", F.when(i % 9 < 3, "test").otherwise("train")).cache()


@pytest.fixture(scope="module")
def parts(rows):
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def test_regression_and_bands(parts):
    train, test = parts
    model = M.fit_gbt_regressor(train, ["a", "b"], "y", max_iter=10, depth=3)
    fit = V.regression_metrics(M.score(model, test, pred="p"), "y", "p").first()
    assert fit.n == test.count() and fit.r2 > 0.9
    bands = M.fit_quantiles(train, ["a", "b"], "y", depth=3)(test)
    got = V.interval_metrics(bands, "y", "q10", "q50", "q90").first()
    assert bands.where("q10 > q50 OR q50 > q90").count() == 0 and 0.6 < got.coverage <= 1.0


def test_stage_models(parts):
    train, test = parts
    for model in (M.fit_stage_model(train, ["a", "b"], "stage", "w", max_iter=3, depth=3), M.fit_forest(train, ["a", "b"], "stage", weight="w", trees=10, depth=5)):
        scored = M.score(model, test, pred="p")
        assert scored.where("p = stage").count() / test.count() > 0.95
    probs = M.stage_probabilities(M.fit_stage_model(train, ["a", "b"], "stage", max_iter=3, depth=3), test, [0, 1, 2])
    total = F.abs(F.col("prob_0") + F.col("prob_1") + F.col("prob_2") - 1)
    assert probs.agg(F.max(total)).first()[0] < 1e-9


def test_alert_model_calibration_and_saved_scores(spark, parts, tmp_path):
    train, test = parts

    def fit(d):
        return M.fit_alert_model(d, ["a", "b"], "alert", "w", max_iter=5, depth=3)

    model = fit(train)
    scored = M.score(model, test, prob="p")
    assert V.roc_auc(scored.withColumn("t", F.col("alert").cast("int")), "t", "p_1").first().auc > 0.98
    calibrated = M.calibrate_isotonic(train, fit, "alert", ["id"])(test, "c")
    assert calibrated.where("c < 0 OR c > 1").count() == 0
    assert calibrated.agg(F.avg(F.abs(F.col("c") - F.col("alert")))).first()[0] < 0.1
    M.save_model(model, str(tmp_path / "m"), {"threshold": "0.5"})
    again, meta = M.load_model(spark, str(tmp_path / "m"))
    both = scored.select("id", "p_1").join(M.score(again, test, prob="q").select("id", "q_1"), "id")
    assert meta == {"threshold": "0.5"} and both.where("p_1 <> q_1").count() == 0


def test_early_stopping_sees_the_validation_rows(rows):
    flipped = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 3, 1 - F.col("alert")).otherwise(F.col("alert"))
    marked = rows.withColumns({"valid": F.col("split") == "test", "alert": flipped})
    model = M.fit_alert_model(marked, ["a", "b"], "alert", validation="valid", max_iter=40, depth=5)
    assert model.stages[-1].getNumTrees < 40


def test_grid_search_prefers_the_deeper_tree(rows):
    def fit(d, depth):
        return M.fit_forest(d, ["a", "b"], "stage", trees=5, depth=depth)

    def predict(model, d):
        return M.score(model, d, pred="p").withColumns({"pred": F.col("p").cast("int"), "stage": F.col("stage").cast("int")})

    best, results = M.grid_search_time(rows, Series(("key",), "day", ("id",)), "stage", fit, {"depth": [1, 5]}, predict)
    assert best == {"depth": 5} and len(results) == 2 and results[1][1] > results[0][1]


def test_models_per_key_take_the_keys_of_the_table(rows):
    def predict(model, d):
        return M.score(model, d, pred="p").select("key", "stage", "p")

    d = rows.withColumn("key", F.when(F.col("key") != "k2", F.col("key")))
    pooled = M.fit_per_key(d, "key", None, lambda t: M.fit_forest(t, ["a", "b"], "stage", trees=5, depth=5), predict)
    want = {r.key: r["count"] for r in d.where("split = 'test'").groupBy("key").count().collect()}
    assert {r.key: r["count"] for r in pooled.groupBy("key").count().collect()} == want and None in want
    with pytest.raises(ValueError):
        M.fit_per_key(d, "key", None, None, predict, most=2)


def test_two_stages_and_importance(parts):
    train, test = parts
    pair = M.fit_two_stage(train, ["a", "b"], "stage", lambda d, f, y: M.fit_alert_model(d, f, y, max_iter=5, depth=3))
    scored = M.score_two_stage(pair, test).withColumn("pred", M.decide_two_stage(F.col("p_alert"), F.col("p_top"), 0.5, 0.5))
    assert scored.where("pred = stage").count() / test.count() > 0.95
    model = M.fit_gbt_regressor(train, ["a", "b"], "y", max_iter=10, depth=3)
    err = F.col("y") - F.col("prediction_value")
    imp = {r.feature: r.importance for r in I.permutation_importance(model, test, ["a", "b"], ["id"], err * err).collect()}
    assert imp["a"] > 10 * abs(imp["b"]) and imp["a"] > 0.5
    assert I.pair_interaction(model, test, ["a", "b"], ["id"], err * err).count() == 1
    curve = [r.mean_prediction for r in I.partial_dependence(model, train, ["a"], points=5).orderBy("point").collect()]
    assert curve == sorted(curve) and math.isclose(curve[-1] - curve[0], 2.7, abs_tol=0.4)


def test_fits_side_by_side_report_failures(rows):
    def fit(d, depth):
        if depth == 3:
            raise ValueError("no such depth")
        return M.fit_forest(d, ["a", "b"], "stage", trees=5, depth=depth)

    def predict(model, d):
        return M.score(model, d, pred="p").withColumns({"pred": F.col("p").cast("int"), "stage": F.col("stage").cast("int")})

    s = Series(("key",), "day", ("id",))
    best, results = M.grid_search_time(rows, s, "stage", fit, {"depth": [1, 3, 5]}, predict)
    assert best == {"depth": 5} and [r[1] is None for r in results] == [False, True, False]
    _, alone = M.grid_search_time(rows, s, "stage", fit, {"depth": [1, 5]}, predict, at_once=1)
    assert [r[1] for r in alone] == [results[0][1], results[2][1]]
    with pytest.raises(RuntimeError, match="no such depth"):
        M.grid_search_time(rows, s, "stage", fit, {"depth": [3]}, predict)
    done = M.side_by_side([("good", lambda: 1), ("bad", lambda: 1 / 0)])
    assert done["good"] == (1, None) and done["bad"][0] is None and "ZeroDivisionError" in done["bad"][1]


def test_leads_and_lengths_side_by_side(rows):
    daily = rows.where("id < 300").withColumn("stage", F.col("stage").cast("int"))
    split = lambda d: d.withColumn("split", F.when(F.dayofmonth("day") < 20, "train").otherwise("test"))
    got = M.compare_leads(daily, Series(("key",), "day", daily=True), "stage", ["a", "b"], split, leads=(1, 3), trees=5, depth=3)
    again = M.compare_leads(daily, Series(("key",), "day", daily=True), "stage", ["a", "b"], split, leads=(1, 3), trees=5, depth=3, at_once=1)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect())) and {r.lead for r in got.collect()} == {1, 3}

    def evaluate(d, n):
        if n == 4:
            raise ValueError("no rows")
        return d.agg(F.count(F.lit(1)).alias("n"))

    with pytest.warns(UserWarning, match="lookback 4"):
        assert {r.lookback for r in M.ablate_lookback(lambda n: rows, evaluate).collect()} == {3, 5}
