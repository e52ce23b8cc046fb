"""Daily forecast: today's look-back features, the stage some days ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.functions.calendar import calendar_features
from tideline.functions.rows import cyclic, fill_from, nan_to_null, row_sum
from tideline.functions.stages import exceeds, stage_from_label, stage_from_value
from tideline.operators import evaluation as V
from tideline.operators import events as E
from tideline.operators import models as M
from tideline.operators import rules as U
from tideline.operators import splits as L
from tideline.operators import thresholds as Th
from tideline.operators import windows as Wn
from tideline.operators.quantiles import median_impute
from tideline.operators.ranking import encode_key
from tideline.operators.resample import interpolate_linear
from tideline.operators.series import Series, measured, over_series
from tideline.session import cut_lineage
from tideline.sources.schema import drop_optional, normalize_headers, select_features

ROLLED = [
    X.WATER_TEMP, X.CHL_A, X.TOTAL, X.PH, X.DO, X.TURBIDITY, X.CLARITY, X.INFLOW, X.OUTFLOW, X.SUNSHINE, X.RAIN, X.RAIN_DAM,
]


@dataclass
class DailyForecast:
    features: DataFrame
    predictions: DataFrame
    by_year: DataFrame
    overall: DataFrame
    recommendations: DataFrame
    episodes: DataFrame
    thresholds: DataFrame


def enrich(raw: DataFrame, s: Series | None = None) -> DataFrame:
    """Stage codes, exceed flags, two-day flags, day-7 and next-week labels."""
    df = nan_to_null(normalize_headers(raw))
    s = s or measured(df, [X.SITE], X.DATE)
    total = F.col(X.TOTAL)
    df = df.withColumns(
        {
            X.STAGE_CODE: stage_from_label(F.col(X.STAGE_LABEL)),
            "stage_from_count": stage_from_value(total),
            **{f"over_{i}": exceeds(total, cut) for i, cut in enumerate(X.STAGE_CUTS, 1)},
        }
    ).withColumn("stage_agrees", F.col(X.STAGE_CODE) == F.col("stage_from_count"))

    def build(w, _):
        both = {
            f"two_days_{i}": F.coalesce(F.col(f"over_{i}"), F.lit(False))
            & F.coalesce(F.lag(f"over_{i}").over(w), F.lit(False))
            for i in range(1, len(X.STAGE_CUTS) + 1)
        }
        return both | {
            "target_d7": F.lead(X.STAGE_CODE, 7).over(w),
            "target_next7_max": F.max(X.STAGE_CODE).over(w.rowsBetween(1, 7)),
        }

    return over_series(df, s, build, back=1, ahead=7)


def add_features(df: DataFrame, s: Series | None = None) -> DataFrame:
    """Seven-day means, rain and flow sums, week-over-week changes, calendar, site code."""
    s = s or measured(df, [X.SITE], X.DATE)
    have = [c for c in ROLLED if c in df.columns]
    df = df.withColumns(
        {
            X.RAIN_SUM: row_sum([c for c in (X.RAIN, X.RAIN_DAM) if c in have]),
            "flow_gap": F.col(X.INFLOW) - F.col(X.OUTFLOW),
        }
    )
    specs = {f"roll7_mean_{c}": (c, 7, "mean") for c in have}
    specs |= {"roll7_rain": (X.RAIN_SUM, 7, "sum"), "roll7_mean_flow_gap": ("flow_gap", 7, "mean")}
    df = Wn.rolling(df, s, specs)
    df = Wn.wow_delta(df, s, [c for c in (X.WATER_TEMP, X.CHL_A, X.TOTAL) if c in have])
    df = Wn.rising_run(df, s, X.TOTAL, 3, "rising3")
    return encode_key(calendar_features(df, X.DATE), X.SITE, "site_code")


def model_features(raw: DataFrame, s: Series | None = None, lead: int = 7) -> DataFrame:
    """Lags, strict rolling statistics, degree sums and seasons for the alert model.

    Everything positional shares the site's order, so it is windowed together.
    """
    df = drop_optional(nan_to_null(normalize_headers(raw)), ["일조시간 합계(hr)", X.CLARITY])
    s = s or measured(df, [X.SITE], X.DATE)
    df = interpolate_linear(df, s, X.SPECIES, limit=14)
    df = df.withColumns(
        {
            X.TOTAL: row_sum(X.SPECIES),
            "stage": stage_from_label(F.col(X.STAGE_LABEL), contains={}),
            X.RAIN: fill_from(F.col(X.RAIN), F.col(X.RAIN_DAM)),
            "temp_diff": F.col(X.WATER_TEMP) - F.col(X.AIR_TEMP),
            "warmth": F.when(F.col(X.MAX_TEMP).isNotNull(), F.greatest(F.col(X.MAX_TEMP), F.lit(10.0))),
        }
    )
    have = set(df.columns)
    counts = [c for c in (X.TOTAL, *X.SPECIES, X.CHL_A) if c in have]
    quality = [c for c in (X.WATER_TEMP, X.PH, X.DO, X.TURBIDITY) if c in have]
    weather = [c for c in (X.AIR_TEMP, X.MAX_TEMP, X.RADIATION, X.WIND, X.HUMIDITY) if c in have]
    rain = [c for c in (X.RAIN, X.RAIN_DAM) if c in have]
    dam = [c for c in (X.LEVEL, X.STORAGE, X.INFLOW, X.OUTFLOW) if c in have]
    lag_steps = {c: [1, 3, 7, 14] for c in (*counts, *rain)} | {c: [1, 3, 7] for c in (*quality, *weather, *dam, "stage")}
    lag_steps["temp_diff"] = [1]
    specs = {}
    for c in counts:
        for n in (3, 7, 14):
            specs[f"{c}_roll{n}m"] = (c, n, "mean")
            specs[f"{c}_roll{n}max"] = (c, n, "max")
    for c in (*quality, *weather, *dam, "temp_diff"):
        specs[f"{c}_roll7m"] = (c, 7, "mean")
    for c in rain:
        specs[f"{c}_roll7sum"] = (c, 7, "sum")
        specs[f"{c}_roll14sum"] = (c, 14, "sum")
    specs |= {"gdd7": ("warmth", 7, "sum"), "gdd14": ("warmth", 14, "sum"), "stage_roll7max": ("stage", 7, "max")}
    df = Wn.rolling(df, s, specs, strict=True)
    for steps in ([1], [1, 3, 7], [1, 3, 7, 14]):
        cols = [c for c, ns in lag_steps.items() if ns == steps]
        if cols:
            df = Wn.lags(df, s, cols, steps)
    df = Wn.lead_label(df, s, "stage", lead, "target").drop("warmth")
    sin, cos = cyclic(F.month(X.DATE), 12)
    return df.withColumns(
        {"month": F.month(X.DATE), "week_of_year": F.weekofyear(X.DATE), "sin_month": sin, "cos_month": cos}
    )


def daily_rules(columns: list[str]):
    """Conditions of the daily rules; a missing input takes the rule's neutral value."""

    def get(name: str, default: float):
        return F.coalesce(F.col(name), F.lit(default)) if name in columns else F.lit(default)

    hot = get(f"{X.AIR_TEMP}_roll7m", 0.0)
    conditions = {
        "S1_고온건조": (hot >= 28) & (get(f"{X.RADIATION}_roll7m", 0.0) >= 18) & (get(f"{X.RAIN}_roll7sum", 99.0) <= 2),
        "S2_저수위_체류": (get(f"{X.STORAGE}_lag1", 100.0) <= 50) & (get(f"{X.WATER_TEMP}_lag1", 0.0) >= 25),
        "S3_관심단계_진입": (get("prob_1", 0.0) >= 0.4) | (get("stage_lag1", 0.0) >= 1),
        "S4_경계단계_임박": (get("prob_2", 0.0) >= 0.3) | (get(f"{X.TOTAL}_lag1", 0.0) >= 5000),
        "S5_강우_후_유입": (get(f"{X.RAIN}_roll7sum", 0.0) >= 30) & (get(f"{X.AIR_TEMP}_lag1", 0.0) >= 25),
    }
    return [(i, holds, X.DAILY_RULE_ACTIONS[i]) for i, holds in conditions.items()]


def forecast(
    raw: DataFrame,
    first_val: str,
    first_test: str,
    lead: int = 7,
    oversample_to: int = 1000,
    trees: int = 100,
    depth: int = 7,
) -> DailyForecast:
    """Features, split, oversampled weighted model, searched thresholds, reports."""
    df = normalize_headers(raw)
    s = measured(df, [X.SITE], X.DATE)
    table = model_features(df, s, lead).where(F.col("target").isNotNull())
    table = table.withColumn("y", F.least("target", F.lit(2)))
    table = L.split_by_dates(table, X.DATE, first_val, first_test)
    feats = select_features(table, exclude=[X.RAIN, "stage", "target", "y", X.STAGE_CODE])
    table = median_impute(cut_lineage(table), feats, F.col("split") == "train")
    # A feature without any training value has no median; it stays at 0.
    table = table.na.fill(0.0, feats)
    train = L.oversample(table.where(F.col("split") == "train"), "y", 2, [X.SITE, X.DATE], target=oversample_to)
    train = L.class_weights(train, "y", {2: X.CLASS_BOOST}, "w").withColumn("label", F.col("y").cast("double"))
    model = M.fit_forest(train, feats, "label", weight="w", trees=trees, depth=depth)
    scored = M.score(model, table.where(F.col("split") != "train"), prob="prob", classes=(0, 1, 2))
    scored = cut_lineage(scored.na.fill(0.0, ["prob_0", "prob_1", "prob_2"]))
    grid = Th.threshold_grid(
        scored.where(F.col("split") == "val"), "y", "prob_1", "prob_2", Th.grid_points(0.08, 0.02, 21), Th.grid_points(0.20, 0.05, 7)
    )
    choice = Th.search_thresholds(grid)
    best = choice.where(F.col("criterion") == "macro_f1").first()
    pred = Th.apply_thresholds(F.col("prob_1"), F.col("prob_2"), best["t_top"], best["t_caution"])
    test = scored.where(F.col("split") == "test").withColumn("pred", pred)
    flat = U.match_rules_flat(test, daily_rules(test.columns), X.DAILY_NO_RULE)
    episodes = E.episodes(test, s, F.col("y") >= 2, detect=F.col("pred") == 2)
    return DailyForecast(
        features=table,
        predictions=test.select(X.DATE, X.SITE, "y", "pred", "prob_0", "prob_1", "prob_2"),
        by_year=V.alert_metrics(test.withColumn("year", F.year(X.DATE)), "y", "pred", by=["year"]),
        overall=V.alert_metrics(test, "y", "pred"),
        recommendations=flat.select(X.DATE, X.SITE, "y", "pred", "rules", "actions"),
        episodes=episodes,
        thresholds=choice,
    )
