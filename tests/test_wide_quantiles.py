"""Quantiles of many columns in one-row passes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import quantiles as Q

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def plain(vs, q):
    vs = sorted(v for v in vs if v is not None and not math.isnan(v))
    if not vs:
        return None
    place = (len(vs) - 1) * q
    low = math.floor(place)
    a, b = vs[low], vs[min(low + 1, len(vs) - 1)]
    return a + (b - a) * (place - low)


@pytest.mark.parametrize("at_once,accuracy", [(20_000, 10_000), (3, 20), (0, 50)])
def test_equals_sorting(spark, monkeypatch, at_once, accuracy):
    monkeypatch.setattr(Q, "AT_ONCE", at_once)
    rng = random.Random(1)
    rows = []
    for i in range(2500):
        rows.append((rng.gauss(0, 1), rng.choice([1.0, 2.0, 2.0, 7.0]), None if i % 3 else rng.random(), float("nan") if i % 2 else float(i), None, rng.randrange(10**6), 5.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f int, g double").repartition(4)
    got = Q.wide_quantiles(df, df.columns, QS, accuracy)
    for i, c in enumerate(df.columns):
        assert got[c] == [plain([r[i] if r[i] is None else float(r[i]) for r in rows], q) for q in QS]
    assert Q.wide_quantiles(df.limit(0), ["a"], QS) == {"a": [None] * len(QS)}
    assert {r.column_name for r in Q.column_quantile_rows(df, df.columns, [0.5], ["m"]).collect()} == set("abcdfg")


def test_medians_fill(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), None), (None, None), (4.0, None)], "a double, b double")
    assert [tuple(r) for r in Q.median_impute(df, ["a", "b"]).collect()] == [(1.0, 0.0), (2.5, 0.0), (2.5, 0.0), (4.0, 0.0)]
    assert Q.median_impute(df, ["a"], fit_on=F.col("a") < 2).where("a = 1").count() == 3
