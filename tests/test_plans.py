"""The three flows and the panel build, end to end on a synthetic site panel."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline import fixed_values as X
from tideline.plans import daily_alert, panel_build, scenario_mining, weekly_alert


def test_panel_build(spark):
    d0 = dt.date(2024, 1, 1)
    samples = spark.createDataFrame(
        [("문의", d0, 1.0, 10.0), ("문의", d0 + dt.timedelta(days=4), 16.0, 14.0), ("추동", d0, 5.0, None)],
        f"`{X.SITE}` string, `{X.DATE}` date, `{X.TOTAL}` double, `{X.WATER_TEMP}` double",
    )
    weather = spark.createDataFrame(
        [("s1", d0, 1.0, None), ("s2", d0, 3.0, None)],
        f"station string, `{X.DATE}` date, `{X.AIR_TEMP}` double, `{X.RAIN}` double",
    )
    dam = spark.createDataFrame([(d0, 70.0)], f"`{X.DATE}` date, `{X.STORAGE}` double")
    out = panel_build.build_panel(samples, weather, dam, counts=[X.TOTAL], quality=[X.WATER_TEMP])
    rows = {(r[X.SITE], r[X.DATE]): r for r in out.collect()}
    assert len(rows) == 6
    assert rows["문의", d0 + dt.timedelta(days=2)][X.WATER_TEMP] == 12.0
    assert rows["추동", d0][X.WATER_TEMP] is None
    assert rows["문의", d0][X.AIR_TEMP] == 2.0 and rows["문의", d0][X.STORAGE] == 70.0
    assert rows["문의", d0 + dt.timedelta(days=1)][X.RAIN] == 0.0


def test_weekly_forecast(site_panel):
    f = weekly_alert.forecast(site_panel, max_iter=2, depth=3, trees=4, forest_depth=6)
    weeks = site_panel.select(F.date_trunc("week", X.DATE)).distinct().count()
    assert f.supervised.count() == 3 * (weeks - 4)
    m = {(r["run"], r["metric"]): r["value"] for r in f.metrics.collect()}
    assert m["ensemble", "auc"] > 0.9 and m["calibrated", "auc"] > 0.9
    assert m["regression", "r2"] > 0.5
    assert m["stage", "accuracy"] > 0.6
    preds = f.predictions.collect()
    assert all(0 <= r["p_calibrated"] <= 1 and r["pred_value"] >= 0 for r in preds)
    recs = f.recommendations.collect()
    assert len(recs) == len(preds) and all(r["scenarios"] for r in recs)
    assert {s["id"] for r in recs for s in r["scenarios"]} <= set(X.WEEKLY_RULES)


def test_daily_features(site_panel):
    d = daily_alert.add_features(daily_alert.enrich(site_panel))
    assert d.count() == site_panel.count()
    r = d.where(F.col(X.SITE) == "문의").orderBy(X.DATE).collect()
    assert r[0]["target_d7"] == r[7][X.STAGE_CODE]
    assert r[0]["target_next7_max"] == max(x[X.STAGE_CODE] for x in r[1:8])
    assert r[3][f"roll7_mean_{X.PH}"] == pytest.approx(sum(x[X.PH] for x in r[:4]) / 4)
    assert {x["site_code"] for x in d.select("site_code").distinct().collect()} == {0, 1, 2}
    assert d.where(~F.col("stage_agrees")).count() == 0


def test_daily_forecast(site_panel):
    f = daily_alert.forecast(site_panel, "2021-07-01", "2022-01-01", oversample_to=500, trees=6, depth=5)
    m = f.overall.first()
    assert m["accuracy"] > 0.6 and m["alert_recall"] > 0.8
    assert f.by_year.count() == 1
    assert f.thresholds.count() == 3
    assert f.episodes.where("detected").count() >= 1
    assert f.recommendations.where(F.col("rules") == X.DAILY_NO_RULE[0]).count() < f.recommendations.count()


def test_scenario_mining(site_panel):
    preds = site_panel.select(
        X.DATE, F.lit(2).alias("target_d7"), F.lit(0).alias("pred_stage"), F.lit(120.0).alias(f"{X.RAIN}_roll7sum")
    )
    out = scenario_mining.mine(site_panel, "문의", preds)
    rows = {name: df.collect() for name, df in out.items()}
    assert sum(r["n"] for r in rows["scenario_rates"]) == site_panel.count()
    assert sum(r["n"] for r in rows["transitions"]) == site_panel.count() - 3
    assert len(rows["month_profile"]) == 4 and len(rows["year_profile"]) == 4
    assert [r["lag"] for r in sorted(rows["lag_correlation"], key=lambda r: r["lag"])] == [0, 3, 7, 10, 14, 21]
    assert rows["miss_types"][0]["n"] == site_panel.count()
    assert all(0 <= r["risk_score"] <= 100 for r in rows["risk_calendar"])
    assert {r["before_event"] for r in rows["pre_transition_contrast"]} == {0, 1}
    assert rows["delayed_after_heatwave"][0]["events"] >= 1
    assert rows["pre_transition_means"][0]["events"] >= 3
