"""Isotonic regression against plain pooling, with every size bound lowered so that each path runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import isotonic as I


def plain(points):
    """Blocks (lo, hi, value, weight) of one group's (x, y, w)."""
    sums = {}
    for x, y, w in points:
        a = sums.setdefault(x, [0.0, 0.0])
        a[0] += w
        a[1] += w * y
    out = []
    for x in sorted(sums):
        block = [x, x, *sums[x]]
        while out and out[-1][3] / out[-1][2] >= block[3] / block[2]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return [(a, b, s / w, w) for a, b, w, s in out]


def rows(seed, kind, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.randrange(200) / 200 if kind == "ties" else rng.random()
        if kind == "arcs":  # convex in pieces: every range keeps many blocks that all merge in the end
            y = round(1000 * (x * 8 % 1) ** 2) + rng.randrange(3)
        elif kind == "rising":  # nothing merges
            y = round(x * 1e6)
        elif kind == "falling":
            y = -round(x * 1e6)
        else:
            y = int(rng.random() < x)
        out.append((rng.choice(["a", "a", "a", "b", None]), x, float(y), float(rng.choice([1, 1, 2, 5]))))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k string, x double, y double, w double").repartition(4)


@pytest.mark.parametrize("at_once", [100_000, 7])
@pytest.mark.parametrize("kind", ["labels", "ties", "arcs", "rising", "falling"])
def test_blocks_equal_plain_pooling(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(I, "AT_ONCE", at_once)
    data = rows(1, kind)
    got = I.fit_isotonic(frame(spark, data), "x", "y", "w", by=["k"]).collect()
    for k in ("a", "b", None):
        want = plain([(x, y, w) for g, x, y, w in data if g == k])
        mine = sorted((r.lo, r.hi, r.value, r.weight) for r in got if r.k == k)
        # Blocks of one value may stand side by side where a stretch was cut.
        joined = []
        for b in mine:
            if joined and math.isclose(joined[-1][2], b[2], rel_tol=1e-12):
                a = joined.pop()
                b = (a[0], b[1], a[2], a[3] + b[3])
            joined.append(b)
        assert [b[:2] for b in joined] == [b[:2] for b in want] and [b[3] for b in joined] == [b[3] for b in want]
        assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(joined, want))


def line(blocks, x):
    knots = [(e, v) for lo, hi, v, _ in blocks for e in ([lo, hi] if lo < hi else [lo])]
    if x <= knots[0][0]:
        return knots[0][1]
    for (a, v), (b, u) in zip(knots, knots[1:]):
        if x <= b:
            return u if x == b else v + (u - v) * (x - a) / (b - a)
    return knots[-1][1]


@pytest.mark.parametrize("cell,broadcast", [(128, 20_000), (3, 2)])
def test_scores_read_the_broken_line(spark, monkeypatch, cell, broadcast):
    monkeypatch.setattr(I, "CELL", cell)
    monkeypatch.setattr(I, "BROADCAST_CELLS", broadcast)
    data = rows(2, "labels")
    blocks = I.fit_isotonic(frame(spark, data), "x", "y", by=["k"])
    asked = [(k, x) for k in ("a", "b", None) for x in [-1.0, 2.0, *[r[1] for r in data[:40]], *[i / 37 for i in range(37)]]]
    asked += [("a", None), ("a", float("nan")), ("none", 0.5)]
    got = I.apply_isotonic(spark.createDataFrame(asked, "k string, q double"), blocks, "q", "c", by=["k"])
    assert got.columns == ["k", "q", "c"]
    want = {k: plain([(x, y, 1.0) for g, x, y, _ in data if g == k]) for k in ("a", "b", None)}
    seen = 0
    for r in got.collect():
        if r.k == "none" or r.q is None or math.isnan(r.q):
            assert r.c is None
        else:
            assert math.isclose(r.c, line(want[r.k], r.q), rel_tol=1e-9, abs_tol=1e-12)
        seen += 1
    assert seen == len(asked)


def test_falling_fits_and_rows_left_out(spark):
    data = rows(3, "labels", 200)
    up = I.fit_isotonic(frame(spark, data), "x", "y", rising=True)
    down = I.fit_isotonic(frame(spark, data).withColumn("y", -F.col("y")), "x", "y", rising=False)
    assert sorted((r.lo, -r.value) for r in down.collect()) == sorted((r.lo, r.value) for r in up.collect())
    odd = [("a", None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0), ("a", 0.1, None, 1.0), ("a", 0.1, 1.0, 0.0), ("a", 0.1, 1.0, None)]
    assert I.fit_isotonic(frame(spark, data + odd), "x", "y", "w").collect() == I.fit_isotonic(frame(spark, data), "x", "y", "w").collect()
    none = I.fit_isotonic(frame(spark, odd), "x", "y", "w", by=["k"])
    assert none.count() == 0
    assert [r.c for r in I.apply_isotonic(frame(spark, data[:5]), none, "x", "c", by=["k"]).collect()] == [None] * 5
