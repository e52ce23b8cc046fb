"""Model queries over the weekly look-back table (MLlib; checked by row count).

Boosted models and forests have the sizes that the plans use by default; only the forests of the
lead-time, look-back, grid and per-key comparisons, which fit many, have fewer trees (``FEWER``).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.series import SUPERVISED_SQL
from tideline.catalog.tables import (
    DAILY,
    PANEL_SQL,
    WEEKLY_SERIES,
    WEEKLY_SQL,
    staged,
    supervised,
)
from tideline.functions.rows import from_log, to_log
from tideline.operators import evaluation as V
from tideline.operators import importance as I
from tideline.operators import models as M
from tideline.operators import splits as L
from tideline.operators.quantiles import median_impute
from tideline.operators.thresholds import apply_thresholds, best_threshold, grid_points, threshold_sweep
from tideline.operators.windows import lags, rolling
from tideline.session import cut_lineage, scratch_path
from tideline.sources.schema import select_features

ITER, DEPTH = 40, 5
STAGE_ITER = 20
TREES, FOREST_DEPTH = 100, 10
FEWER = 30


def learning_table(spark: SparkSession, sf: str, periods: int = 4) -> tuple[DataFrame, list[str]]:
    """Look-back rows with split, log target and filled features."""
    d = supervised(spark, sf, periods)
    feats = select_features(d, prefixes=(f"lw{periods}_", "lw2_", "lw1_"))
    d = cut_lineage(L.time_holdout(d, "week_start"))  # read by the medians and by every fit
    d = median_impute(d, feats, fit_on=F.col("split") == "train")
    d = d.withColumns(
        {
            "y_log": to_log(F.col("y_max")),
            "y3": F.least("y_stage", F.lit(2)).cast("double"),
            "alert": F.col("y_alert").cast("double"),
        }
    )
    return d, feats


def _parts(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _alert(train: DataFrame, feats: list[str], label: str = "alert", seed: int = 42):
    weighted = L.class_weights(train, label, name="w")
    return M.fit_alert_model(weighted, feats, label, weight="w", max_iter=ITER, depth=DEPTH, seed=seed)


def _binary_report(scored: DataFrame, p: str) -> DataFrame:
    d = scored.withColumn("yb", F.col("alert").cast("int"))
    auc = V.roc_auc(d, "yb", p)
    hits = V.alert_metrics(d.withColumn("pb", (F.col(p) >= 0.5).cast("int")), "yb", "pb", labels=(0, 1), top=1)
    return hits.select("n", "accuracy", "alert_recall", "alert_precision", "alert_f1").join(F.broadcast(auc), how="left")


@query("ml_gbt_regression")
def _gbt(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    scored = M.score(model, test, pred="p_log").withColumn("p_raw", from_log(F.col("p_log")))
    return V.regression_metrics(scored, "y_log", "p_log")


@query("ml_stage_model")
def _stage(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_stage_model(L.class_weights(train, "y3", name="w"), feats, "y3", weight="w", max_iter=STAGE_ITER, depth=DEPTH)
    scored = M.stage_probabilities(model, test, [0, 1, 2])
    scored = scored.withColumn("pred", M.argmax_class([F.col(f"prob_{c}") for c in range(3)]))
    return V.class_report(scored.withColumn("truth", F.col("y3").cast("int")), "truth", "pred", [0, 1, 2])


@query("ml_alert_model")
def _alert_model(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    return _binary_report(M.score(_alert(train, feats), test, prob="p"), "p_1")


@query("ml_alert_early_stopping")
def _early(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    cut = F.to_date(F.lit("2000-01-01"))
    train = train.withColumn("late", F.col("week_start") >= cut)
    model = M.fit_alert_model(train, feats, "alert", validation="late", max_iter=ITER, depth=DEPTH)
    return _binary_report(M.score(model, test, prob="p"), "p_1")


@query("ml_random_forest")
def _forest(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    cls = M.fit_forest(L.class_weights(train, "y3", name="w"), feats, "y3", weight="w", trees=TREES, depth=FOREST_DEPTH)
    reg = M.fit_forest(train, feats, "y_log", kind="regressor", trees=TREES, depth=FOREST_DEPTH)
    scored = M.score(cls, test, pred="p_stage")
    scored = M.score(reg, scored, pred="p_log").withColumns(
        {"truth": F.col("y3").cast("int"), "pred": F.col("p_stage").cast("int")}
    )
    return V.alert_metrics(scored, "truth", "pred").select("n", "accuracy", "macro_f1").join(
        F.broadcast(V.regression_metrics(scored, "y_log", "p_log").select("r2", "mae_log")), how="left"
    )


@query("ml_grid_search_time_folds")
def _grid(spark, sf):
    d, feats = learning_table(spark, sf)
    train, _ = _parts(d)

    def fit(rows, depth, trees):
        return M.fit_forest(rows, feats, "y3", trees=trees, depth=depth)

    def predict(model, rows):
        return M.score(model, rows, pred="p").select(
            F.col("y3").cast("int").alias("truth"), F.col("p").cast("int").alias("pred")
        )

    best, tried = M.grid_search_time(train, WEEKLY_SERIES, "truth", fit, {"depth": [4, 10], "trees": [10, FEWER]}, predict, folds=3)
    rows = [(p["depth"], p["trees"], float(s), p == best) for p, s in tried]
    return spark.createDataFrame(rows, "depth int, trees int, macro_f1 double, best boolean")


@query("ml_probability_ensemble")
def _ensemble(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    forest = M.fit_forest(train, feats, "alert", trees=TREES, depth=FOREST_DEPTH)
    scored = M.score(_alert(train, feats), test, prob="a")
    scored = M.score(forest, scored, prob="b")
    scored = scored.withColumn("p", M.average_probs([(1.0, F.col("a_1")), (1.0, F.col("b_1"))]))
    return _binary_report(scored, "p")


@query("ml_isotonic_calibration")
def _isotonic(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    apply = M.calibrate_isotonic(train, partial(_alert, feats=feats), "alert", ["key", "week_start"])
    return _binary_report(apply(test, "p"), "p")


@query("ml_exogenous_only")
def _exogenous(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    outside = select_features(d.select(*feats), without=["top", "stage"])
    return _binary_report(M.score(_alert(train, outside), test, prob="p"), "p_1").withColumn(
        "n_features", F.lit(len(outside))
    )


@query("ml_lookback_ablation")
def _ablation(spark, sf):
    feats = {}

    def build(n):
        d, feats[n] = learning_table(spark, sf, n)
        return d

    def evaluate(d, n):
        train, test = _parts(d)
        model = M.fit_forest(train, feats[n], "y3", trees=FEWER, depth=FOREST_DEPTH)
        scored = M.score(model, test, pred="p").select(
            F.col("y3").cast("int").alias("truth"), F.col("p").cast("int").alias("pred")
        )
        return V.alert_metrics(scored, "truth", "pred").select("n", "accuracy", "macro_f1")

    return M.ablate_lookback(build, evaluate)


def _daily_features(spark, sf):
    d = staged(spark, sf)
    d = lags(d, DAILY, ["top", "total"], [1, 3, 7])
    d = rolling(d, DAILY, {"top_m7": ("top", 7, "mean"), "total_s7": ("total", 7, "sum")}, strict=True)
    return cut_lineage(d), ["top_lag1", "top_lag3", "top_lag7", "total_lag1", "total_lag3", "total_lag7", "top_m7", "total_s7"]


@query("ml_lead_time_comparison")
def _leads(spark, sf):
    d, feats = _daily_features(spark, sf)
    split = partial(L.split_by_dates, time="day", first_val="2000-01-01", first_test="2000-07-01")
    return M.compare_leads(d, DAILY, "stage", feats, split, trees=FEWER, depth=FOREST_DEPTH)


@query("ml_model_per_key")
def _per_key(spark, sf):
    d, feats = learning_table(spark, sf)

    def predict(model, rows):
        return M.score(model, rows, pred="p").select(
            "key", F.col("y3").cast("int").alias("truth"), F.col("p").cast("int").alias("pred")
        )

    pooled = M.fit_per_key(d, "key", None, lambda t: M.fit_forest(t, feats, "y3", trees=FEWER, depth=FOREST_DEPTH), predict)
    return V.alert_metrics(pooled, "truth", "pred", by=["key"])


@query("ml_two_stage_classifier")
def _two_stage(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)

    def fit(rows, features, label):
        balanced = L.oversample(rows, label, 1, ["key", "week_start"], ratio=0.3)
        return M.fit_alert_model(
            balanced.withColumn("w", F.when(F.col(label) == 1, 3.0).otherwise(1.0)), features, label, "w", max_iter=ITER, depth=DEPTH
        )

    # The threshold is chosen on the last fifth of the training weeks, which the models do not see.
    parts = cut_lineage(L.time_holdout(train, "week_start", 0.2, "part"))
    fitted, held = parts.where(F.col("part") == "train").drop("part"), parts.where(F.col("part") == "test").drop("part")
    pair = M.fit_two_stage(fitted, feats, "y3", fit)
    scored = M.score_two_stage(pair, test)
    sweep = threshold_sweep(
        M.score_two_stage(pair, held).withColumn("yb", (F.col("y3") >= 1).cast("int")), "yb", "p_alert", grid_points(0.05, 0.05, 19)
    )
    t = best_threshold(sweep, 0.9).first()["threshold"]
    pred = M.decide_two_stage(F.col("p_alert"), F.col("p_top"), t, 0.3)
    c = M.compose_probs(F.col("p_alert"), F.col("p_top"))
    scored = scored.withColumns({"pred": pred, "truth": F.col("y3").cast("int"), "prob_2": c[2]})
    return V.alert_metrics(scored, "truth", "pred")


@query(
    "scaled_sequence_inputs",
    """SELECT key, week_start, ROUND((lw1_top_max - (SELECT MIN(lw1_top_max) FROM t)) / ((SELECT MAX(lw1_top_max) FROM t) - (SELECT MIN(lw1_top_max) FROM t)), 9) AS minmax,
              ROUND((lw1_top_max - (SELECT AVG(lw1_top_max) FROM t)) / (SELECT STDDEV_SAMP(lw1_top_max) FROM t), 6) AS standard
       FROM supervised""",
    (PANEL_SQL, WEEKLY_SQL, SUPERVISED_SQL, "t AS (SELECT * FROM supervised WHERE week_start < DATE '2000-01-01')"),
)
def _scaled(spark, sf):
    d = supervised(spark, sf)
    train = d.where(F.col("week_start") < F.to_date(F.lit("2000-01-01")))
    a = M.scale_sequences(d, train, ["lw1_top_max"]).withColumnRenamed("scaled_lw1_top_max", "minmax")
    b = M.scale_sequences(a, train, ["lw1_top_max"], kind="standard")
    return b.select(
        "key", "week_start", F.round("minmax", 9).alias("minmax"), F.round("scaled_lw1_top_max", 6).alias("standard")
    )


@query("ml_quantile_bands")
def _bands(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    bands = M.fit_quantiles(train, feats, "y_log", depth=5)(test)
    return V.interval_metrics(bands, "y_log", "q10", "q50", "q90")


@query("ml_permutation_importance")
def _importance(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = _alert(train, feats)
    rows = cut_lineage(test)
    p = F.greatest(F.least(F.col("p_1"), F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = -F.log(F.when(F.col("alert") == 1, p).otherwise(1 - p))
    return I.permutation_importance(model, rows, feats, ["key", "week_start"], loss, by=["y_alert"], prob="p")


@query("ml_pair_interaction")
def _pairs(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    rows = cut_lineage(test)
    err = F.col("y_log") - F.col("prediction_value")
    return I.pair_interaction(model, rows, feats, ["key", "week_start"], err * err)


@query("ml_partial_dependence")
def _pdp(spark, sf):
    d, feats = learning_table(spark, sf)
    train, _ = _parts(d)
    model = M.fit_gbt_regressor(train, feats, "y_log", ITER, DEPTH)
    rows = I.tree_importances(model, train, feats).orderBy(F.col("importance").desc(), "feature").limit(2).collect()
    return I.partial_dependence(model, train, [r["feature"] for r in rows])


@query("ml_saved_model_scores")
def _saved(spark, sf):
    d, feats = learning_table(spark, sf)
    train, test = _parts(d)
    path = scratch_path(spark, "alert_model")
    M.save_model(_alert(train, feats), path, {"features": ",".join(feats), "threshold": "0.5", "classes": "0,1"})
    model, meta = M.load_model(spark, path)
    scored = M.score(model, test, prob="p")
    t = float(meta["threshold"])
    return scored.select("key", "week_start", "p_1", apply_thresholds(F.col("p_1"), F.lit(0.0), 1.0, t).alias("decision"))
