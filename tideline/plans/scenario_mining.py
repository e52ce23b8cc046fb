"""Scenario mining: derived indices, scenarios, profiles, events, transitions, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.functions.rows import argmax_label, bin_by, risk_score, row_sum, shares
from tideline.functions.stages import stage_from_label
from tideline.operators import aggregates as A
from tideline.operators import events as E
from tideline.operators import rules as U
from tideline.operators import windows as Wn
from tideline.operators.quantiles import quantile_with_fallback
from tideline.operators.resample import interpolate_linear
from tideline.operators.series import Series, measured
from tideline.session import cut_lineage
from tideline.sources.schema import normalize_headers


def derive(raw: DataFrame, s: Series | None = None) -> DataFrame:
    """Stress indices, changes, shares, event flags, scenario and risk score per site-day."""
    df = normalize_headers(raw)
    s = s or measured(df, [X.SITE], X.DATE)
    df = interpolate_linear(df, s, X.SPECIES, limit=14)
    df = df.withColumns(
        {
            X.TOTAL: row_sum(X.SPECIES),
            X.RAIN: F.coalesce(F.col(X.RAIN), F.lit(0.0)),
            "stage": F.least(stage_from_label(F.col(X.STAGE_LABEL), contains={}), F.lit(2)),
        }
    )
    df = Wn.stress_indices(df, s, X.AIR_TEMP, X.RAIN)
    df = Wn.rolling(df, s, {"inflow_7sum": (X.INFLOW, 7, "sum"), "rain_7sum": (X.RAIN, 7, "sum")})
    df = Wn.clipped_sum(df, s, X.MAX_TEMP, 10.0, 14, "gdd14")
    df = Wn.diff_n(df, s, X.OUTFLOW, 7, "outflow_delta7")
    df = shares(df, X.SPECIES)
    df = df.withColumns(
        {
            "temp_diff": F.col(X.WATER_TEMP) - F.col(X.AIR_TEMP),
            "dominant": argmax_label([f"{c}_dom" for c in X.SPECIES], X.SPECIES),
        }
    )
    df = E.event_flags(
        df,
        {
            "water_warmer": F.col(X.WATER_TEMP) > F.col(X.AIR_TEMP),
            "discharge_drop": F.col("outflow_delta7") < -50,
            "heavy_rain": F.col("rain_7sum") >= 30,
            "heatwave": F.col("heat_streak") >= 11,
        },
    )
    df = E.onset(df, s, "water_warmer", "cross_event")
    return df.withColumns({"scenario": scenario(), "risk_score": panel_risk()})


def scenario():
    air = U.or_default(F.col(X.AIR_TEMP), 0.0)
    storage = U.or_default(F.col(X.STORAGE), 50.0)
    wind, inflow = U.or_default(F.col(X.WIND), 2.0), U.or_default(F.col(X.INFLOW), 0.0)
    mid = storage.between(60, 80)
    return U.classify_first(
        [
            ("S-RED", (F.col("heat_streak") >= 11) & mid),
            ("S-ORA", (F.col("heavy_rain") == 1) & (air >= 25) & (F.col("outflow_delta7") < -30)),
            ("S-YEL", (air >= 25) & (air < 28) & (wind < 1.0) & mid & (inflow >= 50)),
        ],
        "S-GRN",
    )


def panel_risk(zero_is_missing: bool = True):
    return risk_score(
        {
            "air": F.col(X.AIR_TEMP),
            "water": F.col(X.WATER_TEMP),
            "wind": F.col(X.WIND),
            "storage": F.col(X.STORAGE),
            "inflow7": F.col("inflow_7sum"),
            "outflow": F.col(X.OUTFLOW),
            "heat": F.col("hsi_14"),
        },
        zero_is_missing=zero_is_missing,
    )


def mine(raw: DataFrame, site: str, predictions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the scenario report.

    ``site`` is the site whose weather and dam values stand for all; ``predictions``
    (date, site, target_d7, pred_stage, rain and wind columns) adds the miss types.
    """
    df = normalize_headers(raw)
    s = measured(df, [X.SITE], X.DATE)
    df = cut_lineage(derive(df, s))  # read by every table below
    rep = df.where(F.col(X.SITE) == site)
    top = F.col("stage") == 2
    storage = bin_by(F.col(X.STORAGE), [0, 40, 60, 80, 110], ["<40%", "40-60%", "60-80%", ">80%"])
    inflow = bin_by(F.col(X.INFLOW), [0, 50, 150, 300, 5000], ["<50", "50-150", "150-300", ">300"])
    water = bin_by(F.col(X.WATER_TEMP), [0, 20, 25, 28, 40], ["<20°C", "20-25°C", "25-28°C", ">28°C"])
    cut = quantile_with_fallback(rep, "csi", 0.75, 0.50, 1.0, "csi_cut")
    stressed = df.join(F.broadcast(cut), how="left")
    change = F.when(F.col("outflow_delta7") < -50, "drop").when(F.col("outflow_delta7") > 20, "rise")
    steps = E.transition_rows(df, s, "stage", 1, 2)
    causes = [X.AIR_TEMP, X.WATER_TEMP, X.INFLOW, "hsi_14"]
    out = {
        "scenario_rates": A.rate_by(df, ["scenario"], top),
        "month_profile": A.profile_by(
            df.where(F.month(X.DATE).between(6, 9)), F.month(X.DATE), "month", [X.AIR_TEMP, X.WATER_TEMP, X.TOTAL], top
        ),
        "year_profile": A.profile_by(rep, F.year(X.DATE), "year", ["csi"], top),
        "lag_correlation": A.lag_correlation(rep, s, X.AIR_TEMP, X.WATER_TEMP, [0, 3, 7, 10, 14, 21]),
        "after_crossing": E.post_event_count(rep, s, "cross_event", top, 21),
        "hydraulic_matrix": A.pivot_rate(
            df.withColumns({"storage_bin": storage, "inflow_bin": inflow}),
            "storage_bin", "inflow_bin", ["<50", "50-150", "150-300", ">300"], top,
        ),
        "discharge_change_rates": A.rate_by(df.withColumn("change", change).where(F.col("change").isNotNull()), ["change"], top),
        "stress_rates": A.rate_by(
            stressed.where(F.col("csi").isNotNull()).withColumn("high_stress", F.col("csi") >= F.col("csi_cut")), ["high_stress"], top
        ),
        "transitions": E.transitions(df, s, "stage", [0, 1, 2]),
        "pre_transition_means": E.pre_event_means(steps, rep.drop(X.SITE), [], X.DATE, 7, causes),
        "pre_transition_contrast": E.pre_event_contrast(
            steps, df.where(F.col("stage") == 1), [X.SITE], X.DATE, 7, causes, across_keys=True
        ),
        "composition": A.composition_by(df.withColumn("water_bin", water), "water_bin", [f"{c}_dom" for c in X.SPECIES], top),
        "risk_calendar": rep.select(
            X.DATE, "stage", "scenario", "risk_score", "hsi_14", "csi", "heat_streak",
            X.AIR_TEMP, X.WATER_TEMP, X.STORAGE, X.INFLOW, X.OUTFLOW,
        ),
        "actions": U.attach_actions(df.groupBy("scenario").agg(F.count(F.lit(1)).alias("n")), X.SCENARIO_ACTIONS, "scenario"),
    }
    for name in ("heatwave", "heavy_rain", "discharge_drop"):
        starts = E.onset(rep, s, name, "__starts", default=None)
        out[f"delayed_after_{name}"] = E.delayed_response(starts, s, "__starts", top, 30)
    if predictions is not None:
        rain = f"{X.RAIN}_roll7sum"
        wet = F.coalesce(F.col(rain), F.lit(0.0)) if rain in predictions.columns else F.lit(0.0)
        out["miss_types"] = U.classify_misses(predictions, "target_d7", "pred_stage", 2, wet, F.month(X.DATE), X.MISS_TYPES)
    return out
