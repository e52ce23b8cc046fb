"""Models per key against a plain solver for each key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import keyed_models as K

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """Nine keys and the null key of different sizes; key 7 has one class, key 8 one row, key 6 a constant feature."""
    u = lambda s: (F.xxhash64("id", F.lit(s)).bitwiseAND(2**40 - 1) + 0.5) / 2**40
    d = spark.range(2000).select("id", (10 * u(1)).alias("a"), (100 + u(2)).alias("b"), u(3).alias("t"), (1 + F.col("id") % 3).alias("w"))
    key = F.when(F.col("id") < 1000, 0).when(F.col("id") == 1999, 8).when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.col("id") % 8)
    d = d.withColumn("k", key.cast("int")).withColumn("b", F.when(F.col("k") == 6, 100.5).otherwise(F.col("b")))
    hit = (F.col("t") < 1 / (1 + F.exp(-(F.col("a") - 5 + F.coalesce("k", F.lit(0)) / 4)))) | F.col("k").eqNullSafe(7)
    d = d.withColumns({"y": hit.cast("int"), "v": 2 * F.col("a") - 3 * F.col("b") + F.coalesce("k", F.lit(9)) + F.col("t")})
    return d.repartition(5).cache()


def by_key(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.k, []).append(r)
    means = [np.mean([r[f] for rs in out.values() for r in rs]) for f in FEATURES]
    scales = [np.std([r[f] for rs in out.values() for r in rs]) for f in FEATURES]
    for k, rs in out.items():
        x = np.array([[1.0, *[(r[f] - m) / s for f, m, s in zip(FEATURES, means, scales)]] for r in rs])
        yield k, rs, x, np.array([r.w for r in rs], dtype=float), means, scales


def unscaled(b, means, scales):
    slopes = b[1:] / scales
    return np.array([b[0] - slopes @ means, *slopes])


def test_linear_models(rows):
    got = {r.k: r for r in K.fit_linear_per_key(rows, "k", FEATURES, "v", "w", penalty=0.5).collect()}
    for k, rs, x, w, means, scales in by_key(rows):
        h = (x * w[:, None]).T @ x + np.diag([0, 0.5, 0.5])
        b = np.linalg.lstsq(h, (x * w[:, None]).T @ np.array([r.v for r in rs]), rcond=1e-12)[0]
        r = got.pop(k)
        assert r.n == len(rs) and np.allclose([r.intercept, r.a, r.b], unscaled(b, means, scales), rtol=1e-6, atol=1e-6)
    assert not got
    plain = {r.k: r for r in K.fit_linear_per_key(rows, "k", ["a"], "v").collect()}
    assert plain[8].n == 1 and sum(r.n for r in plain.values()) == 2000


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_logistic_models(rows, monkeypatch, broadcast):
    monkeypatch.setattr(K, "BROADCAST_KEYS", broadcast)
    odd = rows.unionByName(rows.limit(3).withColumn("a", F.lit(None).cast("double")))
    models = K.fit_logistic_per_key(odd, "k", FEATURES, "y", "w", penalty=0.3)
    got = {r.k: r for r in models.collect()}
    assert len(got) == 10 and all(r.settled for r in got.values())
    for k, rs, x, w, means, scales in by_key(rows):
        y, b = np.array([r.y for r in rs]), np.zeros(3)
        loss = lambda c: np.sum(w * (np.logaddexp(0, x @ c) - y * (x @ c))) + 0.15 * (c**2).sum()  # noqa: E731, B023
        for _ in range(100):  # plain Newton from the origin, halving while the loss rises
            p = 1 / (1 + np.exp(-x @ b))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(3), x.T @ (w * (y - p)) - 0.3 * b)
            while loss(b + step) > loss(b) + 1e-12 and np.abs(step).max() > 1e-12:
                step = step / 2
            b = b + step
        r = got[k]
        assert np.allclose([r.intercept, r.a, r.b], unscaled(b, means, scales), rtol=1e-5, atol=1e-5)
    scored = K.score_per_key(rows, models, "k", FEATURES, "p", K.logistic).where("k <> 7")
    assert scored.where((F.col("p") > 0.5) == (F.col("y") == 1)).count() / scored.count() > 0.8


def test_ten_thousand_keys_take_as_many_jobs_as_ten(spark):
    u = (F.xxhash64("id").bitwiseAND(2**40 - 1) + 0.5) / 2**40
    counts = []
    for keys in (10, 10_000):
        d = spark.range(keys * 12).select((F.col("id") % keys).alias("k"), u.alias("a"), (F.rand(3) < u).cast("int").alias("y"))
        spark.sparkContext.setJobGroup(f"keys-{keys}", "fit")
        models = K.fit_logistic_per_key(d, "k", ["a"], "y", rounds=6)
        assert models.count() == keys
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"keys-{keys}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= 2 * counts[0] and counts[1] < 200


def test_penalty_and_missing_keys(rows):
    with pytest.raises(ValueError):
        K.fit_logistic_per_key(rows, "k", FEATURES, "y", penalty=0.0)
    models = K.fit_linear_per_key(rows.where("k = 1"), "k", FEATURES, "v")
    assert K.score_per_key(rows, models, "k", FEATURES, "p").where("p IS NOT NULL").select("k").distinct().collect() == [(1,)]
