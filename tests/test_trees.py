"""Node-table operators against walks of the model's own trees and against rows copied per value."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import importance as I
from tideline.operators import models as M
from tideline.operators import trees as T

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    d = spark.range(400).select(
        i, (F.pmod(i * 37, F.lit(101)) / 100).alias("a"), (F.pmod(i * 53, F.lit(97)) / 96).alias("b"), (F.pmod(i * 71, F.lit(89)) / 88).alias("c")
    )
    y = 3 * F.col("a") + F.when(F.col("b") > 0.5, 2 * F.col("c")).otherwise(0.0)
    d = d.withColumns({"y": y, "stage": F.when(y > 3, 2.0).when(y > 1.5, 1.0).otherwise(0.0), "alert": (y > 2).cast("double"), "w": i % 3 + 1.0})
    return d.repartition(3).cache()


@pytest.fixture(scope="module")
def models(rows):
    return {
        "boosted regression": M.fit_gbt_regressor(rows, FEATURES, "y", max_iter=6, depth=3),
        "boosted classes": M.fit_alert_model(rows, FEATURES, "alert", "w", max_iter=5, depth=3),
        "forest": M.fit_forest(rows, FEATURES, "y", kind="regressor", trees=7, depth=4),
        "forest of classes": M.fit_forest(rows, FEATURES, "stage", weight="w", trees=5, depth=4),
    }


def predicted(model, row, kind):
    """Per class: what the model says, on the scale in which trees add up."""
    if kind == "forest of classes":
        return list(row["probability"])
    if kind == "boosted classes":
        p = row["probability"][1]
        return [0.5 * math.log(p / (1 - p))]
    return [row["prediction"]]


@pytest.mark.parametrize("kind", ["boosted regression", "boosted classes", "forest", "forest of classes"])
def test_contributions_and_base_are_the_prediction(rows, models, kind):
    model = models[kind]
    base = {r["class"]: r.base for r in T.bases(T.leaf_paths(T.node_table(model))).collect()}
    got = {}
    for r in T.attribute(model, rows, FEATURES, ["id"]).collect():
        got.setdefault((r.id, r["class"]), {})[r.feature] = r.contribution
    for row in model.transform(rows).collect():
        for c, p in enumerate(predicted(model, row, kind)):
            parts = got.get((row.id, c), {})
            assert set(parts) <= set(FEATURES) and math.isclose(base[c] + sum(parts.values()), p, abs_tol=1e-9)
    groups = rows.withColumn("k", F.when(F.col("id") % 2 == 0, "even"))
    means = T.mean_attribution(model, groups, FEATURES, by=["k"]).collect()
    assert {r.k for r in means} == {"even", None}
    for r in means:
        ids = [i for i in range(400) if (i % 2 == 0) == (r.k == "even")]
        want = sum(got.get((i, r["class"]), {}).get(r.feature, 0.0) for i in ids) / len(ids)
        assert math.isclose(r.contribution, want, abs_tol=1e-9)
    summary = T.attribution_summary(T.attribute(model, rows, FEATURES, ["id"]), 400).collect()
    for r in summary:
        mine = [g.get(r.feature, 0.0) for (_, c), g in got.items() if c == r["class"]]
        assert math.isclose(r["mean"], sum(mine) / 400, abs_tol=1e-9) and math.isclose(r.mean_abs, sum(map(abs, mine)) / 400, abs_tol=1e-9)


def test_contributions_are_moves_along_the_path(rows, models):
    """Against a walk of the model's own printed trees."""
    model = models["forest"]
    nodes = {}
    for r in T.node_table(model).collect():
        nodes.setdefault(r.tree, {})[r.node] = r
    got = {}
    for r in T.attribute(model, rows, FEATURES, ["id"]).collect():
        got[r.id, r.feature] = r.contribution
    for row in rows.limit(60).collect():
        want = dict.fromkeys(FEATURES, 0.0)
        for tree in nodes.values():
            at = tree[0]
            while at.left is not None:
                child = tree[at.left if row[FEATURES[at.feature]] <= at.threshold else at.right]
                want[FEATURES[at.feature]] += (child["values"][0] - at["values"][0]) / len(nodes)
                at = child
        assert all(math.isclose(got.get((row.id, f), 0.0), v, abs_tol=1e-9) for f, v in want.items())


@pytest.mark.parametrize("at_once", [1_000_000, 20])
@pytest.mark.parametrize("kind", ["boosted regression", "forest", "forest of classes"])
def test_partial_dependence_equals_copied_rows(rows, models, monkeypatch, kind, at_once):
    monkeypatch.setattr(T, "NODES_AT_ONCE", at_once)
    model, cls = models[kind], 2 if kind == "forest of classes" else 0
    grid = T.even_grid(rows, FEATURES, points=6)
    got = {(r.feature, r.point): (r.value, r.mean_prediction) for r in T.partial_dependence(model, rows, FEATURES, grid, cls).collect()}
    assert len(got) == 18
    for (f, _), (value, mean) in got.items():
        scored = model.transform(rows.withColumn(f, F.lit(value))).collect()
        assert math.isclose(mean, sum(predicted(model, r, kind)[cls] for r in scored) / 400, abs_tol=1e-9)
    if kind == "boosted regression":
        copied = {(r.feature, r.point): r.mean_prediction for r in I.partial_dependence(model, rows, FEATURES, points=6).collect()}
        assert copied.keys() == got.keys() and all(math.isclose(v, got[k][1], abs_tol=1e-9) for k, v in copied.items())


@pytest.mark.parametrize("kind", ["boosted regression", "forest"])
def test_interactions_equal_copied_rows(rows, models, kind):
    model = models[kind]
    grid = T.even_grid(rows, FEATURES, points=3)
    got = {(r.f1, r.f2): (r.interaction, r.share) for r in T.interactions(model, rows, FEATURES, grid, top=None).collect()}
    values = {}
    for r in grid.collect():
        values.setdefault(r.feature, []).append(r.value)

    def mean(**fixed):
        d = rows.withColumns({f: F.lit(v) for f, v in fixed.items()}) if fixed else rows
        return model.transform(d).agg(F.avg("prediction")).first()[0]

    whole, single = mean(), {(f, v): mean(**{f: v}) for f in FEATURES for v in values[f]}
    for i, f in enumerate(FEATURES):
        for g in FEATURES[i + 1 :]:
            joint = [(mean(**{f: x, g: y}), single[f, x], single[g, y]) for x in values[f] for y in values[g]]
            rms = math.sqrt(sum((j - a - b + whole) ** 2 for j, a, b in joint) / len(joint))
            assert math.isclose(got.get((f, g), (0.0, 0))[0], rms, abs_tol=1e-9)
            centre = sum(j for j, _, _ in joint) / len(joint)
            spread = math.sqrt(sum((j - centre) ** 2 for j, _, _ in joint) / len(joint))
            if (f, g) in got:
                assert math.isclose(got[f, g][1], rms / spread, rel_tol=1e-6)
    assert [tuple(r)[:2] for r in T.interactions(model, rows, FEATURES, grid, top=1).collect()] == [max(got, key=lambda p: got[p][0])]


def test_no_rows_are_exploded(rows, models):
    nodes = T.node_table(models["forest"])
    plan = T.branch_counts(rows, FEATURES, nodes, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1
