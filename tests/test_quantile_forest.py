"""Forest quantiles against weights over all training rows, and coverage on data of known spread."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import quantile_forest as Q
from tideline.operators import trees as T


def table(spark, n, seed):
    """y scatters by 0.2 + x around x; z is noise. Every value is drawn by hash, so the table is the same on every run."""
    u = lambda s: (F.xxhash64("id", F.lit(seed), F.lit(s)).bitwiseAND(2**40 - 1) + 0.5) / 2**40
    gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    d = spark.range(n).select("id", u(3).alias("x"), u(4).alias("z"), gauss.alias("e"))
    return d.withColumn("y", F.col("x") + (0.2 + F.col("x")) * F.col("e")).drop("e")


@pytest.mark.parametrize("bins", [1, 5, 200])
def test_equals_weights_over_all_rows(spark, monkeypatch, bins):
    train = table(spark, 300, 1).withColumn("y", F.round("y", 1)).cache()  # with ties
    test = table(spark, 25, 2).cache()
    fitted = {}
    fit = Q._fit
    monkeypatch.setattr(Q, "_fit", lambda *a: fitted.setdefault("model", fit(*a)))
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    odd = train.unionByName(train.limit(1).withColumn("y", F.lit(None).cast("double")))
    got = {r.id: r for r in Q.fit_quantile_forest(odd, ["x", "z"], "y", qs, trees=6, depth=4, min_rows=5, bins=bins)(test, ["id"]).collect()}
    leaf = {}
    for name, rows in (("train", train), ("test", test)):
        for r in T.leaves_of(fitted["model"], rows.withColumn("k", F.col("id")), ["k"]).collect():
            leaf[name, r.k, r.tree] = r.leaf
    ys = {r.id: r.y for r in train.collect()}
    assert set(got) == set(range(25))
    for i, row in got.items():
        weight = dict.fromkeys(ys, 0.0)
        for t in range(6):
            mine = [j for j in ys if leaf["train", j, t] == leaf["test", i, t]]
            for j in mine:
                weight[j] += 1 / len(mine) / 6
        for q in qs:
            want = next(y for y in sorted(set(ys.values())) if sum(w for j, w in weight.items() if ys[j] <= y) > 0 and sum(w for j, w in weight.items() if ys[j] <= y) >= q - 1e-9)
            assert row[f"q{round(q * 100)}"] == want


def test_coverage_is_nominal(spark):
    bands = Q.fit_quantile_forest(table(spark, 6000, 1), ["x", "z"], "y", trees=40, depth=6, min_rows=60)
    test = table(spark, 4000, 2)
    met = bands(test, ["id"]).join(test, "id").cache()
    inside = F.col("y").between(F.col("q10"), F.col("q90"))
    share = met.agg(F.avg(inside.cast("double"))).first()[0]
    assert 0.77 < share < 0.83
    # Wide where y scatters, narrow where it does not.
    width = {r.h: r.w for r in met.groupBy((F.col("x") > 0.5).alias("h")).agg(F.avg(F.col("q90") - F.col("q10")).alias("w")).collect()}
    assert width[True] > 1.5 * width[False]
    assert met.where("q10 > q50 OR q50 > q90").count() == 0
    for half in (F.col("x") > 0.5, F.col("x") <= 0.5):
        assert 0.74 < met.where(half).agg(F.avg(inside.cast("double"))).first()[0] < 0.86
