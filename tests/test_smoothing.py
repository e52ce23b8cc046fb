"""Smoothing against the plain recursion, with blocks so short that series are composed over several rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import smoothing as S
from tideline.operators.series import Series


def series(seed=1):
    rng = random.Random(seed)
    out = {}
    for k, n, drift in (("a", 1, 0), ("b", 2, 0), ("c", 37, 0.0), ("d", 120, 0.9), ("e", 64, 0.3)):
        level, vs = 1000.0, []
        for _ in range(n):
            level += rng.gauss(0, drift)
            vs.append(level + rng.gauss(0, 1))
        out[k] = vs
    return out


def frame(spark, data):
    rows = [(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)]
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("i").cast("int"))
    return spark.createDataFrame(rows, "k string, i int, v double").withColumn("day", day).repartition(3)


def errors(vs, a, start):
    level, sse = start, 0.0
    for v in vs:
        sse += (v - level) ** 2
        level += a * (v - level)
    return sse, level


def best_start(vs, a):
    """The level of least squared error, from errors at three levels (they are a parabola)."""
    m = sum(vs) / len(vs)
    e0, e1, e2 = (errors([v - m for v in vs], a, x)[0] for x in (-1.0, 0.0, 1.0))
    return m + (e0 - e2) / (2 * (e0 - 2 * e1 + e2))


@pytest.mark.parametrize("block,fan", [(512, 512), (4, 3)])
def test_fixed_factors_equal_the_recursion(spark, monkeypatch, block, fan):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "FAN", fan)
    data, factors = series(), [0.0, 0.1, 0.5, 1.0]
    for start in ("estimated", "first"):
        got = {(r.k, r.factor): r for r in S.fit_smoothing(frame(spark, data), Series(("k",), "day"), "v", factors, start).collect()}
        assert len(got) == 20
        for (k, a), r in got.items():
            level = best_start(data[k], a) if start == "estimated" else data[k][0]
            sse, forecast = errors(data[k], a, level)
            assert r.n == len(data[k]) and math.isclose(r.start, level, abs_tol=1e-6)
            assert math.isclose(r.error, sse, abs_tol=1e-6, rel_tol=1e-6) and math.isclose(r.forecast, forecast, abs_tol=1e-6)


def test_estimated_factor_is_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "FAN", 2)
    data = series(2)
    got = {r.k: r for r in S.fit_smoothing(frame(spark, data).unionByName(frame(spark, {"c": [None]}).limit(0)), Series(("k",), "day"), "v").collect()}
    for k in ("c", "d", "e"):
        tried = [errors(data[k], i / 2000, best_start(data[k], i / 2000))[0] for i in range(2001)]
        assert got[k].error <= min(tried) * (1 + 1e-9)
        sse, forecast = errors(data[k], got[k].factor, got[k].start)
        assert math.isclose(sse, got[k].error, rel_tol=1e-6) and math.isclose(forecast, got[k].forecast, rel_tol=1e-9)
    assert got["c"].factor < 0.2 < got["d"].factor


def test_holdout(spark):
    data = series(3)
    data["d"][5] = None
    s = Series(("k",), "day", daily=True)
    got = {r.k: r for r in S.smoothing_holdout(frame(spark, data), s, "v").collect()}
    assert set(got) == {"c", "d", "e"}
    for k, r in got.items():
        n = len(data[k])
        cut = math.floor(n * 0.85)
        vs = list(data[k])
        known = sorted(v for v in vs[:cut] if v is not None)
        median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
        vs = [median if v is None else v for v in vs]
        assert (r.n, r.holdout_n) == (n, n - cut)
        assert math.isclose(r.mae_naive, sum(abs(vs[i] - vs[i - 1]) for i in range(cut, n)) / (n - cut), rel_tol=1e-9)
        _, forecast = errors(vs[:cut], r.factor, r.start)
        assert math.isclose(r.mae_smooth, sum(abs(v - forecast) for v in vs[cut:]) / (n - cut), rel_tol=1e-6)
