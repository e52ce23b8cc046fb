"""Weekly forecast: four weeks back, next week's stage, alert and count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.functions.rows import from_log, row_sum, to_log
from tideline.functions.stages import label_from_code
from tideline.operators import evaluation as V
from tideline.operators import models as M
from tideline.operators import rules as U
from tideline.operators import splits as L
from tideline.operators.quantiles import exact_quantiles, median_impute
from tideline.operators.ranking import encode_key
from tideline.operators.resample import to_weekly
from tideline.operators.series import Series
from tideline.operators.windows import lookback
from tideline.session import cut_lineage
from tideline.sources.schema import coerce_types, drop_missing, normalize_headers, select_features

WEEK = "week_start_target"
SERIES = Series((X.SITE,), WEEK, daily=True)
MEASURES = [
    *X.SPECIES, X.WATER_TEMP, X.PH, X.DO, X.TURBIDITY, X.CHL_A, X.CLARITY, X.SUNSHINE,
    X.INFLOW, X.OUTFLOW, X.LEVEL, X.STORAGE,
]
SHORT = [
    f"{X.TOTAL}_max", f"{X.TOTAL}_mean", f"{X.STAGE_CODE}_max", f"{X.WATER_TEMP}_mean", f"{X.CHL_A}_mean",
    f"{X.INFLOW}_mean", f"{X.OUTFLOW}_mean", X.WEEK_RAIN, f"{X.SUNSHINE}_mean",
]


@dataclass
class Forecast:
    supervised: DataFrame
    predictions: DataFrame
    recommendations: DataFrame
    metrics: DataFrame


def prepare(raw: DataFrame) -> DataFrame:
    """Typed panel with a daily rain sum; rows without date or site are dropped."""
    df = normalize_headers(raw)
    numbers = [X.TOTAL, X.STAGE_CODE, X.RAIN, X.RAIN_DAM, *MEASURES]
    df = drop_missing(coerce_types(df, numbers, [X.DATE]), [X.DATE, X.SITE])
    if X.RAIN_SUM not in df.columns:
        df = df.withColumn(X.RAIN_SUM, row_sum([c for c in (X.RAIN, X.RAIN_DAM) if c in df.columns]))
    return df


def weekly_panel(df: DataFrame) -> DataFrame:
    """Site by week; columns the panel lacks are left out."""
    spec = {
        f"{X.TOTAL}_mean": (X.TOTAL, "mean"),
        f"{X.TOTAL}_max": (X.TOTAL, "max"),
        f"{X.STAGE_CODE}_max": (X.STAGE_CODE, "max"),
        **{f"{c}_mean": (c, "mean") for c in MEASURES},
        X.WEEK_RAIN: (X.RAIN_SUM, "sum"),
    }
    have = set(df.columns)
    return to_weekly(df, [X.SITE], X.DATE, {o: s for o, s in spec.items() if s[0] in have}, name=WEEK)


def supervised_table(weekly: DataFrame, periods: int = 4) -> DataFrame:
    """Look-back features of each week with its own values as labels."""
    tracked = [c for c in weekly.columns if c not in (X.SITE, WEEK)]
    stage = F.floor(F.col(f"{X.STAGE_CODE}_max")).cast("int")
    return lookback(
        weekly,
        SERIES,
        tracked,
        periods,
        short=[c for c in SHORT if c in tracked],
        labels={
            "y_max": F.col(f"{X.TOTAL}_max"),
            "y_mean": F.col(f"{X.TOTAL}_mean"),
            "y_stage": stage,
            "y_alert": (stage >= 1).cast("int"),
        },
        carry=[f"{X.STAGE_CODE}_max", f"{X.TOTAL}_max"],
    ).drop(*tracked)


def weekly_rules(p_alert: str, pred_value: str, ref_inflow: str, columns: list[str]):
    """Recommendation array of a scored look-back row."""

    def lw(kind: str, name: str):
        c = f"lw4_{kind}_{name}"
        return F.col(c) if c in columns else F.lit(None).cast("double")

    water, sun = lw("mean", f"{X.WATER_TEMP}_mean"), lw("slope", f"{X.SUNSHINE}_mean")
    out, rain = lw("slope", f"{X.OUTFLOW}_mean"), lw("slope", X.WEEK_RAIN)
    chl, ph = lw("slope", f"{X.CHL_A}_mean"), lw("slope", f"{X.PH}_mean")
    inflow = lw("mean", f"{X.INFLOW}_mean")
    title, cond, expect, acts = X.WEEKLY_RULES["SX"]
    said = F.format_string(
        cond,
        F.bround(F.col(p_alert) * 100, 0).cast("bigint").cast("string"),
        F.bround(F.col(pred_value), 0).cast("bigint").cast("string"),
    )
    rec = {k: U.recommendation(k, *v) for k, v in X.WEEKLY_RULES.items() if k != "SX"}
    rules = [
        ((water > 22) & (sun > 0) & (out < 0), rec["S1"]),
        ((rain > 20) & (inflow > F.col(ref_inflow) * 1.1), rec["S2"]),
        ((out < 0) & (water > 20), rec["S3"]),
        ((chl > 0) & (ph > 0), rec["S4"]),
        (F.col(p_alert) >= 0.45, U.recommendation("SX", title, said, expect, acts)),
    ]
    return U.match_rules(rules, rec["S0"])


def forecast(
    raw: DataFrame, holdout: float = 0.15, max_iter: int = 40, depth: int = 5, trees: int = 250, forest_depth: int = 14, impute_all: bool = False
) -> Forecast:
    """The whole flow from a raw panel to predictions, recommendations and metrics.

    ``impute_all`` takes feature medians from all rows; the default takes them from
    the training weeks only.
    """
    table = supervised_table(weekly_panel(prepare(raw))).na.drop(subset=["y_max", "y_stage"])
    feats = select_features(table, prefixes=("lw4_", "lw2_", "lw1_"))
    table = encode_key(table, X.SITE, "site_code", first_seen=[X.SITE])
    table = cut_lineage(L.time_holdout(table, WEEK, holdout))  # the medians and every fit below read it
    table = median_impute(table, feats, None if impute_all else F.col("split") == "train")
    table = table.withColumns(
        {
            "y_log": to_log(F.col("y_max")),
            "y3": F.least(F.greatest("y_stage", F.lit(0)), F.lit(3)).cast("double"),
            "y_bin": F.col("y_alert").cast("double"),
        }
    )
    feats = [*feats, "site_code"]
    train, test = table.where(F.col("split") == "train"), table.where(F.col("split") == "test")

    reg = M.fit_gbt_regressor(train, feats, "y_log", max_iter, depth)
    staged = L.class_weights(train, "y3", name="w")
    classes = [0, 1, 2, 3]
    forest = M.fit_forest(staged, feats, "y3", weight="w", trees=trees, depth=forest_depth)
    weighted = L.class_weights(train, "y_bin", name="w")

    def alert(rows: DataFrame):
        return M.fit_alert_model(rows, feats, "y_bin", "w", max_iter=max_iter, depth=depth)

    boosted = alert(weighted)
    bagged = M.fit_forest(weighted, feats, "y_bin", weight="w", trees=trees, depth=forest_depth)
    calibrate = M.calibrate_isotonic(weighted, alert, "y_bin", [X.SITE, WEEK])
    outside = [c for c in feats if not any(part in c for part in X.ENDOGENOUS)]
    exo = M.fit_alert_model(weighted, outside, "y_bin", "w", max_iter=max_iter, depth=depth)

    scored = M.score(reg, test, pred="pred_log")
    scored = M.score(forest, scored, prob="stage", classes=classes)
    scored = M.score(boosted, scored, prob="p_boosted")
    scored = M.score(bagged, scored, prob="p_bagged")
    scored = M.score(exo, scored, prob="p_exogenous")
    scored = calibrate(scored, "p_calibrated")
    stage_probs = [F.coalesce(F.col(f"stage_{c}"), F.lit(0.0)) for c in classes]
    scored = scored.withColumns(
        {
            "pred_stage": M.argmax_class(stage_probs),
            "pred_value": from_log(F.col("pred_log")),
            "p_ensemble": M.average_probs([(1.0, F.col("p_boosted_1")), (1.0, F.col("p_bagged_1"))]),
        }
    ).withColumns(
        {
            "y_stage_name": label_from_code(F.col("y_stage"), X.STAGE_NAMES),
            "pred_stage_name": label_from_code(F.col("pred_stage"), X.STAGE_NAMES),
            "decision_ensemble": (F.col("p_ensemble") >= 0.5).cast("int"),
            "decision_calibrated": (F.col("p_calibrated") >= 0.5).cast("int"),
        }
    )
    inflow = f"lw4_mean_{X.INFLOW}_mean"
    if inflow in table.columns:
        ref = exact_quantiles(table, inflow, [0.5], names=["ref_inflow"])
        scored = scored.join(F.broadcast(ref), how="left")
    else:
        scored = scored.withColumn("ref_inflow", F.lit(None).cast("double"))
    scored = cut_lineage(scored)
    rec = scored.withColumn("scenarios", weekly_rules("p_calibrated", "pred_value", "ref_inflow", scored.columns))
    keep = [
        WEEK, X.SITE, "y_stage", "y_stage_name", "y_alert", "y_max", "pred_stage", "pred_stage_name", "pred_value",
        "p_boosted_1", "p_ensemble", "p_calibrated", "p_exogenous_1", "decision_ensemble", "decision_calibrated",
    ]
    return Forecast(
        supervised=table,
        predictions=scored.select(*keep),
        recommendations=rec.select(X.SITE, WEEK, "p_ensemble", "p_calibrated", "pred_stage", "pred_value", "scenarios"),
        metrics=_metrics(scored),
    )


def _metrics(scored: DataFrame) -> DataFrame:
    """Tidy (run, metric, value) rows of every model and of persistence."""
    reg = V.tidy_metrics(V.regression_metrics(scored, "y_log", "pred_log"), "regression", ["r2", "mae_log", "mae_raw"])
    truth = scored.withColumn("truth", F.least("y_stage", F.lit(3)))
    stage = V.alert_metrics(truth, "truth", "pred_stage", labels=(0, 1, 2, 3))
    out = reg.unionByName(V.tidy_metrics(stage, "stage", ["accuracy", "macro_f1", "top_recall"]))
    prev = truth.withColumn("prev", F.coalesce(F.col(f"persist_{X.STAGE_CODE}_max").cast("int"), F.lit(0)))
    base = V.alert_metrics(prev, "truth", "prev", labels=(0, 1, 2, 3))
    out = out.unionByName(V.tidy_metrics(base, "persistence", ["accuracy", "macro_f1", "top_recall"]))
    boundary = V.mask_f1(truth, "truth", "pred_stage", 2, "f1")
    out = out.unionByName(V.tidy_metrics(boundary, "boundary", ["f1"]))
    for run, p in [
        ("boosted", "p_boosted_1"), ("ensemble", "p_ensemble"), ("calibrated", "p_calibrated"), ("exogenous", "p_exogenous_1"),
    ]:
        hits = scored.withColumn("d", (F.col(p) >= 0.5).cast("int"))
        m = V.alert_metrics(hits, "y_alert", "d", labels=(0, 1), top=1)
        out = out.unionByName(V.tidy_metrics(m, run, ["accuracy", "alert_f1", "alert_recall", "alert_precision"]))
        out = out.unionByName(V.tidy_metrics(V.roc_auc(scored, "y_alert", p), run, ["auc"]))
    return out
