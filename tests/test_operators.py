"""Quantiles, ranks, range joins and metrics against brute force and golden numbers."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import conformal as C
from tideline.operators import evaluation as V
from tideline.operators import events as E
from tideline.operators import joins as J
from tideline.operators import splits as L
from tideline.operators import thresholds as Th
from tideline.operators.baselines import ses_baseline
from tideline.operators.quantiles import exact_quantiles, median_impute, quantile_with_fallback
from tideline.operators.ranking import encode_key, global_rank, hash_rank, running_totals
from tideline.operators.series import Series


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    # one group holds most rows, another is nearly constant
    data = [("big", rng.gauss(0, 100)) for _ in range(3000)]
    data += [("tied", float(rng.choice([0, 0, 0, 1]))) for _ in range(500)] + [("one", 7.5)]
    data += [("big", None), ("tied", float("nan"))]
    return data, spark.createDataFrame(data, "g string, v double").cache()


def clean(data, g=None):
    return np.array([v for k, v in data if v is not None and v == v and (g is None or k == g)])


@pytest.mark.parametrize("accuracy", [5, 100, 10_000])
def test_quantiles_exact_whatever_the_sketch(values, accuracy):
    data, d = values
    qs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    rows = {r["g"]: r for r in exact_quantiles(d, "v", qs, by=["g"], accuracy=accuracy).collect()}
    for g in ("big", "tied", "one"):
        want = np.quantile(clean(data, g), qs)
        got = [rows[g][f"q{round(q * 100)}"] for q in qs]
        assert got == pytest.approx(list(want)), g
    whole = exact_quantiles(d, "v", [0.25], accuracy=accuracy).first()["q25"]
    assert whole == pytest.approx(np.quantile(clean(data), 0.25))


def test_quantile_fallback(spark):
    d = spark.createDataFrame([(0.0,)] * 9 + [(2.0,), (4.0,)], "v double")
    assert quantile_with_fallback(d, "v", 0.75, 0.5, 1.0, "c").first()[0] == 3.0
    assert quantile_with_fallback(d, "v", 1.0, 0.5, 1.0, "c").first()[0] == 4.0
    assert quantile_with_fallback(d.where("v = 0"), "v", 0.75, 0.5, 1.0, "c").first()[0] == 1.0


def test_impute_scopes_and_infinities(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, float("inf")), (2, None), (2, 9.0)], "t int, v double")
    train = [r["v"] for r in median_impute(d, ["v"], F.col("t") == 1).orderBy("t", "v").collect()]
    assert sorted(train) == [1, 2, 2, 3, 9]
    whole = [r["v"] for r in median_impute(d, ["v"]).collect()]
    assert sorted(whole) == [1, 3, 3, 3, 9]


def test_ranks(spark, values):
    _, d = values
    ids = d.withColumn("id", F.monotonically_increasing_id())
    ranked = hash_rank(ids, ["id"], 1, by=["g"]).groupBy("g").agg(
        F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count(F.lit(1))
    )
    for _, lo, hi, n, rows in ranked.collect():
        assert (lo, hi, n) == (0, rows - 1, rows)
    names = spark.createDataFrame([(x,) for x in "dbcabbd"], "k string")
    coded = {r["k"]: r["c"] for r in encode_key(names, "k", "c").collect()}
    assert coded == {"a": 0, "b": 1, "c": 2, "d": 3}
    total = [r["rank"] for r in global_rank(ids.select("id"), ["id"]).orderBy("id").collect()]
    assert total == list(range(len(total)))


def test_running_totals(values):
    data, d = values
    rows = running_totals(d.where(~F.isnan("v")), "v", {"n": F.lit(1)}, parts=16).collect()
    ordered = np.sort(clean(data))
    for r in random.Random(1).sample(rows, 200):
        assert r["before_n"] == np.searchsorted(ordered, r["v"], side="left")


@pytest.fixture(scope="module")
def two_tables(spark):
    rng = random.Random(9)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(200))
    ev = [(rng.choice(["hot", "hot", "b"]), day(), i) for i in range(40)]
    rows = [(rng.choice(["hot", "hot", "b", "c"]), day(), i, float(rng.randrange(9))) for i in range(400)]
    return (
        spark.createDataFrame(ev, "k string, e date, eid int").cache(),
        spark.createDataFrame(rows, "k string, d date, rid int, v double").cache(),
    )


@pytest.mark.parametrize("days", [1, 7, 30])
def test_range_joins_equal_naive(two_tables, days):
    ev, rows = two_tables
    gap = F.datediff("d", "e")
    naive = ev.join(rows, "k")
    after = J.after_events(ev, rows, ["k"], "e", "d", days).select("eid", "rid").collect()
    assert sorted(after) == sorted(naive.where((gap > 0) & (gap <= days)).select("eid", "rid").collect())
    before = J.before_events(ev, rows, ["k"], "e", "d", days).select("eid", "rid").collect()
    assert sorted(before) == sorted(naive.where((gap < 0) & (gap >= -days)).select("eid", "rid").collect())
    sums = J.range_totals(ev, rows, ["k"], "e", "d", 1, days, {"n": F.lit(1).cast("long"), "s": F.col("v")})
    want = {r["eid"]: (r["n"], r["s"]) for r in naive.where((gap > 0) & (gap <= days)).groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    for r in sums.collect():
        assert (r["n"], r["s"]) == want.get(r["eid"], (0, 0.0))
    marked = J.mark_in_windows(rows, ev, ["k"], "d", "e", days, "m").where("m = 1").select("rid").collect()
    assert sorted(marked) == sorted(naive.where((gap < 0) & (gap >= -days)).select("rid").distinct().collect())


def test_align_mean_default(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, d int")
    b = spark.createDataFrame([("p", 1, 0.2), ("q", 1, 0.6)], "k string, d int, p double")
    rows = J.align_mean(a, b, "d", ["p"], 1 / 3).orderBy("d").collect()
    assert [r["aligned_p"] for r in rows] == [pytest.approx(0.4), pytest.approx(1 / 3)]


def test_delays_equal_pairing(two_tables):
    _, rows = two_tables
    d = rows.groupBy("k", "d").agg(F.max("v").alias("v")).withColumn("f", (F.col("v") > 5).cast("int"))
    s = Series(("k",), "d", daily=True)
    got = {(r["k"], r["d"]): r["delay"] for r in E.delays(d, s, "f", F.col("v") == 8, 20).collect()}
    hits = [(r["k"], r["d"]) for r in d.where("v = 8").collect()]
    for (k, day), delay in got.items():
        later = [(h - day).days for kk, h in hits if kk == k and 0 < (h - day).days <= 20]
        assert delay == (min(later) if later else None)


GOLDEN = {(0, 0): 123, (0, 1): 1, (1, 0): 8, (1, 1): 34, (2, 1): 54, (2, 2): 8}


def test_golden_confusion_accuracy(spark):
    rows = [p for p, n in GOLDEN.items() for _ in range(n)]
    d = spark.createDataFrame(rows, "y int, p int")
    cells = {(r["truth"], r["pred"]): r["n"] for r in V.confusion(d, "y", "p", [0, 1, 2]).collect()}
    assert cells == {(i, j): GOLDEN.get((i, j), 0) for i in range(3) for j in range(3)}
    m = V.alert_metrics(d, "y", "p").first()
    assert m["accuracy"] == pytest.approx(165 / 228)
    assert m["top_recall"] == pytest.approx(8 / 62)
    f1 = [2 * 123 / (124 + 131), 2 * 34 / (42 + 89), 2 * 8 / (62 + 8)]
    assert m["macro_f1"] == pytest.approx(sum(f1) / 3)


def test_golden_cost_row(spark):
    rows = [(1, 0.9)] * 99 + [(1, 0.01)] * 5 + [(0, 0.9)] * 3 + [(0, 0.01)] * 121
    d = spark.createDataFrame(rows, "y int, s double")
    r = Th.threshold_sweep(d, "y", "s", Th.grid_points(0.05, 0.05, 19)).orderBy("threshold").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["cost"]) == (99, 121, 3, 5, 18.0)
    assert (round(r["recall"], 4), round(r["precision"], 4)) == (0.9519, 0.9706)


def test_macro_f1_skips_absent_classes(spark):
    d = spark.createDataFrame([(0, 0), (1, 1)], "y int, p int")
    m = V.alert_metrics(d, "y", "p").first()
    assert m["macro_f1"] == 1.0 and m["top_recall"] is None


def test_auc_is_mann_whitney(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(300)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    d = spark.createDataFrame(rows, "y int, s double")
    assert V.roc_auc(d, "y", "s").first()["auc"] == pytest.approx(want)
    assert V.roc_auc(d.where("y = 1"), "y", "s").first()["auc"] is None


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        p2 = round(rng.random() * 0.5, 3)
        rows.append((i, rng.choice([0, 0, 1, 2]), round(rng.random() * (1 - p2), 3), p2))
    return rows, spark.createDataFrame(rows, "i int, y int, p1 double, p2 double").cache()


def test_threshold_grid_equals_naive(scored):
    rows, d = scored
    tops, cautions = Th.grid_points(0.05, 0.07, 5), Th.grid_points(0.1, 0.1, 6)
    grid = {(r["i_top"], r["i_caution"]): r for r in Th.threshold_grid(d, "y", "p1", "p2", tops, cautions).collect()}
    assert len(grid) == 30
    for i, tb in enumerate(tops):
        for j, tc in enumerate(cautions):
            pred = [2 if p2 >= tb else 1 if p1 >= tc else 0 for _, _, p1, p2 in rows]
            ys = [r[1] for r in rows]
            fp = sum(1 for y, p in zip(ys, pred) if y == 0 and p >= 1)
            fn = sum(1 for y, p in zip(ys, pred) if y >= 1 and p == 0)
            f1s = []
            for c in range(3):
                tp = sum(1 for y, p in zip(ys, pred) if y == p == c)
                both = ys.count(c) + pred.count(c)
                if both:
                    f1s.append(2 * tp / both)
            r = grid[i, j]
            assert (r["fp"], r["fn"], r["cost"]) == (fp, fn, fp + 3 * fn)
            assert r["macro_f1"] == pytest.approx(sum(f1s) / len(f1s))


def test_pair_cost_grid_equals_naive(scored):
    rows, d = scored
    grid_a, grid_t = Th.grid_points(0.1, 0.2, 4), Th.grid_points(0.05, 0.1, 4)
    got = Th.pair_cost_grid(d.withColumn("a", F.col("p1") + F.col("p2")), "y", "a", "p2", grid_a, grid_t).collect()
    assert len(got) == 16
    for r in got:
        pred = [(p1 + p2 >= r["t_alert"], p2 >= r["t_top"]) for _, _, p1, p2 in rows]
        cost = sum((a and y == 0) + 3 * (not a and y >= 1) for (_, y, _, _), (a, _) in zip(rows, pred))
        hits = sum(a and t and y == 2 for (_, y, _, _), (a, t) in zip(rows, pred))
        assert r["cost"] == cost
        assert r["top_recall"] == pytest.approx(hits / sum(1 for x in rows if x[1] == 2))


def test_conformal_equals_numpy(scored):
    rows, d = scored
    d = d.withColumns({"b": (F.col("y") >= 1).cast("int"), "p": F.col("p1") + F.col("p2")})
    cal, test = d.where("i % 2 = 0"), d.where("i % 2 = 1")
    arr = np.array([(int(y >= 1), p1 + p2) for _, y, p1, p2 in rows])
    c, t = arr[::2], arr[1::2]
    nc = np.where(c[:, 0] == 1, 1 - c[:, 1], c[:, 1])
    n = len(nc)
    for r in C.conformal(cal, test, "b", "p", [0.1, 0.3, 0.001]).collect():
        q = np.quantile(nc, min(np.ceil((n + 1) * (1 - r["alpha"])) / n, 1.0))
        inside = t[:, 1] >= 1 - q
        assert r["quantile"] == pytest.approx(q)
        assert r["coverage"] == pytest.approx(inside[t[:, 0] == 1].mean())
        assert r["specificity"] == pytest.approx((~inside)[t[:, 0] == 0].mean())
        assert r["efficiency"] == pytest.approx(1 - inside.mean())


def test_oversample_spreads_copies_evenly(spark):
    d = spark.createDataFrame([(i, 1 if i < 7 else 0) for i in range(50)], "i int, y int")
    out = L.oversample(d, "y", 1, ["i"], target=24)
    copies = [r["count"] for r in out.where("y = 1").groupBy("i").count().collect()]
    assert sorted(copies) == [3, 3, 3, 3, 4, 4, 4]
    assert out.where("y = 0").count() == 43
    assert L.oversample(d, "y", 1, ["i"], target=3).where("y = 1").count() == 7


def test_sampling_is_repeatable(spark):
    d = spark.range(1000)
    a = L.sample_rows(d, 37, ["id"]).collect()
    b = L.sample_rows(d.repartition(7), 37, ["id"]).collect()
    assert len(a) == 37 and sorted(a) == sorted(b)
    assert L.sample_rows(d, 5000, ["id"]).count() == 1000


def test_weights(spark):
    d = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "y int")
    w = {r["y"]: r["weight"] for r in L.class_weight_table(d, "y", {2: 3.0}).collect()}
    assert w == {0: pytest.approx(10 / 18), 1: pytest.approx(10 / 9), 2: pytest.approx(10)}
    dated = d.withColumn("yr", F.when(F.col("y") == 2, 2020).otherwise(2019))
    out = L.year_class_weights(dated, "y", F.col("yr"), {2020: 2.0}, 1.0, {2: 3.0})
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_smoothing_baseline(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=7 * i), float(v)) for i, v in enumerate([5] * 17 + [5, 9, 9])]
    d = spark.createDataFrame(rows, "k string, w date, v double")
    r = ses_baseline(d, Series(("k",), "w", daily=True), "v", [0.2, 0.8]).first()
    assert (r["n"], r["holdout_n"], r["forecast"]) == (20, 3, 5.0)
    assert r["mae_naive"] == pytest.approx(4 / 3) and r["mae_smooth"] == pytest.approx(8 / 3)


def test_interval_metrics(spark):
    d = spark.createDataFrame([(5.0, 1.0, 4.0, 6.0), (9.0, 1.0, 4.0, 6.0)], "y double, lo double, mid double, hi double")
    m = V.interval_metrics(d, "y", "lo", "mid", "hi").first()
    assert (m["coverage"], m["mean_width"], m["median_mae"]) == (0.5, 5.0, 3.0)
    assert m["pinball_90"] == pytest.approx((0.1 * 1 + 0.9 * 3) / 2)
