"""Readers, writers, typing and feature lists."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.sources.readers import read_optional, read_panel, read_recommendations
from tideline.sources.schema import coerce_types, normalize_headers, require_columns, select_features
from tideline.sources.writers import write_table


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("조사일,수온(℃)\n2024-01-01,3.5\nbad,x\n", encoding="utf-8-sig")
    d = read_panel(spark, str(tmp_path / "a.csv"))
    assert d.columns == ["조사일", "수온(℃)"]
    rows = coerce_types(d, ["수온(℃)"], ["조사일", "absent"]).collect()
    assert [str(r[0]) for r in rows] == ["2024-01-01", "None"] and [r[1] for r in rows] == [3.5, None]


def test_csv_in_legacy_code_page(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("지점,값\n대청,1\n".encode("cp949"))
    assert read_panel(spark, str(tmp_path / "b.csv"), encoding="cp949").first()[0] == "대청"


def test_optional_table(spark, tmp_path):
    assert read_optional(spark, str(tmp_path / "none.csv")) is None
    write_table(spark.range(3), str(tmp_path / "t"), "parquet")
    assert read_optional(spark, str(tmp_path / "t"), "parquet").count() == 3


def test_required_columns(spark):
    d = spark.range(1).withColumn("b", F.lit(1))
    assert require_columns(d, ["id"]) is d
    with pytest.raises(ValueError, match=r"\['a', 'z'\]"):
        require_columns(d, ["z", "a", "b"])


def test_headers(spark):
    d = spark.range(1).toDF(" 수위(EL.m)\n ")
    assert normalize_headers(d).columns == ["수위(EL_m)"]
    assert normalize_headers(d, {"수위(EL_m)": "level"}).columns == ["level"]


def test_recommendation_document(spark, tmp_path):
    doc = [
        {"채수위치": "문의", "week_start_target": "2024-01-01", "pred_stage": 1,
         "scenarios": [{"id": "S1", "title": "t", "조건": "c", "예상": "e", "권고": ["x", "y"]}]},
        {"채수위치": "추동", "week_start_target": "2024-01-08", "scenarios": []},
    ]
    (tmp_path / "r.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    rows = read_recommendations(spark, str(tmp_path / "r.json")).orderBy("week_start_target").collect()
    assert rows[0]["scenarios"][0]["권고"] == ["x", "y"] and rows[1]["scenarios"] == []


def test_feature_lists(spark):
    d = spark.range(1).selectExpr("1.0 AS lw4_a", "true AS lw1_b", "'x' AS lw2_c", "1 AS y", "2.0 AS lw4_stage")
    assert select_features(d, prefixes=("lw4_", "lw1_", "lw2_")) == ["lw1_b", "lw4_a", "lw4_stage"]
    assert select_features(d, prefixes=("lw4_",), without=["stage"]) == ["lw4_a"]
    assert select_features(d, exclude=["y"], containing=["lw4"]) == ["lw4_a", "lw4_stage"]
