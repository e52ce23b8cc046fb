import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import whitening as W
from tideline.llm.catalog import queries

from .conftest import SF


def frame(spark, vectors, kind="float"):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def plain(vectors, components):
    """Per usable vector (integers, deviation, values) by numpy on the whole matrix, with exact integers."""
    floors = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in enumerate(vectors) if usable(v)}
    fit = sorted(set(floors.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, dtype=float) - np.array(sums) / n
    e, v = np.linalg.eigh(x.T @ x / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, f in floors.items():
        z = (np.array(f) - np.array(sums) / n) @ v[:, :components] / np.sqrt(e[:components])
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(f, sums)), z)
    return out, e / e.sum()


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def compare(df, vectors, components=4):
    want, share = plain(vectors, components)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = None
    for i, rows in sorted(got.items()):
        assert sorted(rows) == list(range(1, components + 1))
        n, deviation, z = want[i]
        mine = np.array([rows[c].whitened for c in sorted(rows)])
        if signs is None and np.abs(z).min() > 1e-3:
            signs = np.sign(mine * z)
        for c, r in rows.items():
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(share[c - 1], rel=1e-9) and r.identity_error < 1e-9
    for i, rows in got.items():
        mine = np.array([rows[c].whitened for c in sorted(rows)])
        assert np.allclose(mine * signs, want[i][2], atol=1e-8)


def gauss(rng, n, d, scales):
    return [[rng.gauss(0.1 * j, scales[j]) for j in range(d)] for _ in range(n)]


def test_equals_whole_matrix(spark):
    rng = random.Random(1)
    vectors = gauss(rng, 400, 9, [3.0, 2, 1.5, 1, 0.8, 0.4, 0.2, 0.1, 0.05])
    vectors += vectors[:150] + [vectors[3]] * 200  # copies stand once in the fit list
    vectors += [None, [], [None] * 9, [float("nan")] * 9, [float("inf")] + [0.0] * 8, vectors[0][:8] + [None]]
    compare(W.whiten(frame(spark, vectors)), vectors)


def test_query_on_the_table(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    compare(queries()["op11_whitening"](spark, SF), [r.embedding for r in rows])


def test_ill_conditioned_columns(spark):
    """The smallest singular value is found to many digits although its square is lost beside the largest."""
    rng = random.Random(2)
    vectors = [[2.0**22 * round(rng.gauss(0, 2**8)) for _ in range(3)] + [rng.gauss(0, 1)] for _ in range(300)]
    fit = W.fit_list(frame(spark, vectors, "double").select(W.integers(F.col("embedding")).alias("x")))
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=float) - fit.mean
    r = W.triangular(fit)
    want = np.linalg.svd(x, compute_uv=False)
    assert want[0] / want[-1] > 1e8
    assert np.allclose(np.linalg.svd(r, compute_uv=False), want, rtol=1e-7)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-10, atol=1e-10 * (x.T @ x).max())


def test_dependent_columns_are_left_out(spark):
    rng = random.Random(3)
    a = [[rng.randrange(-99, 99) / 256.0 for _ in range(2)] for _ in range(80)]
    vectors = [[p, q, p + q, 7.0, -2 * p] for p, q in a]
    got = W.whiten(frame(spark, vectors), components=4)
    assert sorted(r[0] for r in got.select("component").distinct().collect()) == [1, 2]
    compare(got, vectors, components=2)


def test_exact_deviation_beyond_doubles_and_longs(spark):
    big = [[1e3 * i, -1e2 * i * i] for i in range(1, 40)]
    compare(W.whiten(frame(spark, big), components=2), big, 2)
    x = np.array([[2**40, -(2**40)], [1, 2]])
    assert W.deviations(x, 10**6, [5, 7]) == [None, (10**6 - 5) ** 2 + (2 * 10**6 - 7) ** 2]
    assert W.column_sums(np.array([[2**62], [2**62], [2**62], [-1]])) == [3 * 2**62 - 1]


def test_edges(spark):
    one = frame(spark, [[1.0, 2.0]] * 5)
    assert W.whiten(one).count() == 0 and W.whiten(one.limit(0)).count() == 0 and W.whiten(frame(spark, [None, []])).count() == 0
    assert W.whiten(one).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    odd = [[0.0, 1.0], [1.0, 0.5], [2.0, 4.0], [5.0], [-0.0, 1.0]]
    got = W.whiten(frame(spark, odd).withColumns({c: F.lit(1) for c in ("x", "n", "d", "i", "s", "component", "row")}))
    assert sorted((r.vec_id, r.component) for r in got.collect()) == [(i, c) for i in (0, 1, 2, 4) for c in (1, 2)]
    assert {r.n for r in got.collect()} == {3}
    keys = frame(spark, odd[:3] * 2).withColumn("vec_id", F.when(F.col("vec_id") < 3, F.col("vec_id").cast("string")))
    assert W.whiten(keys).where("vec_id IS NULL").count() == 6
