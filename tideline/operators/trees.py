"""Fitted forests as tables: nodes, leaf paths, attribution, partial dependence and interaction.

``node_table`` reads a fitted MLlib forest as rows. From there on a model is data: what a row reacted to is a join of
its leaves with the leaf's path, and how the mean prediction depends on a feature is a sum over leaves of rows counted once.

**Attribution** is by path: at each split the prediction moves from the node's value to the child's, and the
move is put down to the split's feature. A row's contributions and the base (mean of the roots) add up to its
prediction. Means over rows need no row at all, only how many rows came to each leaf.

**Partial dependence** sets a feature to a value in every row and averages. A row set so comes to a leaf
exactly if it meets the leaf's conditions on the other features, so one count a leaf and feature serves every value.
``branch_counts`` sends the rows down the trees once, letting each row miss the conditions of up to one or two
features, and counts them by leaf and missed features; the tables of one and of two features follow by sums over leaves.
Two features that never meet on a path do not interact.

Trees on categorical features are refused: the features here are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.quantiles import column_quantile_rows
from tideline.session import cut_lineage, scratch_path

#: Rows of a table of leaves that are sent to every executor (under 100 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Nodes that a task which sends rows down the trees holds at once; more trees take more passes.
NODES_AT_ONCE = 1_000_000


def node_table(model: PipelineModel) -> DataFrame:
    """tree, node (0 is the root, then depth first), left, right, feature, threshold, values, cover, share.

    Rows go left up to the threshold. ``values`` is what the node predicts: class probabilities of a
    classification forest, else one number (for boosted classifiers the margin). ``cover`` is the weight of
    the training rows; ``share`` the tree's weight in the sum that makes the prediction.
    """
    fitted = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    fitted.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if not saved.where(F.col("split.numCategories") > 0).isEmpty():
        raise ValueError("categorical splits are not supported")
    weights = [float(w) for w in fitted.treeWeights]
    forest = "RandomForest" in type(fitted).__name__
    scale = 1.0 / sum(weights) if forest else 1.0
    share = F.get(F.array(*[F.lit(w * scale) for w in weights]), F.col("treeID"))
    stats = F.col("impurityStats")
    classes = forest and getattr(fitted, "numClasses", 0) > 0
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    values = F.transform(stats, lambda s: s / total) if classes else F.array("prediction")
    leaf = F.col("leftChild") < 0
    return saved.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        values.alias("values"),
        (total if classes else F.get(stats, F.lit(0))).alias("cover"),
        share.alias("share"),
    )


_STEP = "struct<feature: int, threshold: double, right: boolean, move: array<double>>"


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf (from 0, depth first), values, base, share and the steps to the leaf; a task holds one tree."""

    def paths(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        root = rows[0]
        steps: dict[int, list[dict]] = {root["node"]: []}
        at = {r["node"]: r for r in rows}
        out = []
        for r in rows:  # parents come before their children
            mine = steps.pop(r["node"])
            if r["left"] is None:
                out.append({"tree": r["tree"], "leaf": len(out), "values": r["values"], "base": root["values"], "share": r["share"], "steps": mine})
                continue
            for side in ("left", "right"):
                move = [b - a for a, b in zip(r["values"], at[r[side]]["values"])]
                step = {"feature": r["feature"], "threshold": r["threshold"], "right": side == "right", "move": move}
                steps[r[side]] = [*mine, step]
        kind = pa.struct([("feature", pa.int32()), ("threshold", pa.float64()), ("right", pa.bool_()), ("move", pa.list_(pa.float64()))])
        fields = [("tree", pa.int32()), ("leaf", pa.int32()), ("values", pa.list_(pa.float64())), ("base", pa.list_(pa.float64())), ("share", pa.float64()), ("steps", pa.list_(kind))]
        return pa.Table.from_pylist(out, schema=pa.schema(fields))

    schema = f"tree int, leaf int, values array<double>, base array<double>, share double, steps array<{_STEP}>"
    return nodes.groupBy("tree").applyInArrow(paths, schema)


def _small(df: DataFrame) -> DataFrame:
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def leaf_moves(paths: DataFrame) -> DataFrame:
    """tree, leaf, class, feature, move: what the features on a leaf's path add to the prediction."""
    steps = paths.select("tree", "leaf", "share", F.explode("steps").alias("s"))
    each = steps.select("tree", "leaf", "s.feature", F.posexplode("s.move").alias("class", "m"), "share")
    return each.groupBy("tree", "leaf", "class", "feature").agg(F.sum(F.col("m") * F.col("share")).alias("move"))


def bases(paths: DataFrame) -> DataFrame:
    """class, base: what the model predicts before any split."""
    roots = paths.groupBy("tree").agg(F.first("base").alias("base"), F.first("share").alias("share"))
    each = roots.select("share", F.posexplode("base").alias("class", "b"))
    return each.groupBy("class").agg(F.sum(F.col("b") * F.col("share")).alias("base"))


def leaves_of(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, tree and leaf: one row per row and tree."""
    head, last = model.stages[:-1], model.stages[-1].copy()
    ready = rows
    for stage in head:
        ready = stage.transform(ready)
    scored = last.setLeafCol("__leaves").transform(ready)
    # One row per tree; the leaf numbers run depth first, as in leaf_paths.
    return scored.select(*keep, F.posexplode(vector_to_array("__leaves")).alias("tree", "__l")).select(
        *keep, "tree", F.col("__l").cast("int").alias("leaf")
    )


def _named(features: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(f) for f in features]), F.col("feature"))


def attribute(model: PipelineModel, rows: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """ids, class, feature, contribution: one row per row, class and feature on its paths.

    ``ids`` must tell rows apart. The contributions of a row and the class's base (``bases``) add up to its prediction.
    """
    moves = _small(leaf_moves(leaf_paths(node_table(model))))
    met = leaves_of(model, rows, ids).join(moves, ["tree", "leaf"])
    sums = met.groupBy(*ids, "class", "feature").agg(F.sum("move").alias("contribution"))
    return sums.withColumn("feature", _named(features))


def mean_attribution(model: PipelineModel, rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, class, feature, contribution: means over the rows of each group, from the number of rows in each leaf."""
    moves = _small(leaf_moves(leaf_paths(node_table(model))))
    counts = leaves_of(model, rows, by).groupBy(*by, "tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    # Every row is in one leaf of each tree.
    size = counts.where(F.col("tree") == 0).groupBy(*by).agg(F.sum("n").alias("rows"))
    sums = counts.join(moves, ["tree", "leaf"]).groupBy(*by, "class", "feature").agg(F.sum(F.col("n") * F.col("move")).alias("sum"))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], "class", "feature", "sum")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = sums.join(F.broadcast(size), same) if by else sums.join(F.broadcast(size), how="left")
    return joined.select(*by, "class", _named(features).alias("feature"), (F.col("sum") / F.col("rows")).alias("contribution"))


def attribution_summary(contributions: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """by, class, feature, mean, mean_abs over ``n`` rows of each group; a feature off a row's paths counts 0 there."""
    c = F.col("contribution")
    return contributions.groupBy(*by, "class", "feature").agg((F.sum(c) / n).alias("mean"), (F.sum(F.abs(c)) / n).alias("mean_abs"))


def _walk(tree: dict[str, np.ndarray], x: np.ndarray, free: int, add) -> None:
    """Send rows down a tree; a row may miss the conditions of up to ``free`` features."""
    leaf = tree["leaf"]
    none = np.full(len(x), -1, dtype=np.int32)
    todo = [(0, np.arange(len(x)), none, none)]
    while todo:
        node, at, one, two = todo.pop()
        f = tree["feature"][node]
        if f < 0:
            add(leaf[node], one, two)
            continue
        goes_right = x[at, f] > tree["threshold"][node]
        for child, meets in ((tree["left"][node], ~goes_right), (tree["right"][node], goes_right)):
            known = meets | (one == f) | (two == f)
            first = ~known & (one < 0) if free >= 1 else np.zeros(len(at), dtype=bool)
            second = ~known & (one >= 0) & (two < 0) if free >= 2 else np.zeros(len(at), dtype=bool)
            stay = known | first | second
            if stay.any():
                a, b = np.where(first, f, one), np.where(second, f, two)
                todo.append((child, at[stay], a[stay], b[stay]))


def branch_counts(rows: DataFrame, features: Sequence[str], nodes: DataFrame, free: int) -> DataFrame:
    """tree, leaf, f, g, n: rows that miss the leaf's conditions on exactly features f and g (-1: on none, on one only)."""
    known = nodes.select("tree", "node", "left", "right", "feature", "threshold").orderBy("tree", "node").toPandas()
    trees, sizes = [], known.groupby("tree").size().to_dict()
    for t, part in known.groupby("tree"):
        is_leaf = part["feature"].isna().to_numpy()
        trees.append(
            (
                int(t),
                {
                    "feature": part["feature"].fillna(-1).to_numpy(dtype=np.int32),
                    "threshold": part["threshold"].fillna(0.0).to_numpy(),
                    "left": part["left"].fillna(-1).to_numpy(dtype=np.int64),
                    "right": part["right"].fillna(-1).to_numpy(dtype=np.int64),
                    "leaf": np.where(is_leaf, np.cumsum(is_leaf) - 1, -1),
                },
            )
        )
    chunks, size = [[]], 0
    for t, tree in trees:
        if chunks[-1] and size + sizes[t] > NODES_AT_ONCE:
            chunks.append([])
            size = 0
        chunks[-1].append((t, tree))
        size += sizes[t]
    x = rows.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    width = len(features) + 1

    def counter(chunk):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int, int, int], int] = {}
            for batch in batches:
                matrix = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for t, tree in chunk:

                    def add(leaf: int, one: np.ndarray, two: np.ndarray) -> None:
                        low, high = np.where(two < 0, one, np.minimum(one, two)), np.where(two < 0, two, np.maximum(one, two))
                        for code, n in zip(*np.unique((low + 1) * width + high + 1, return_counts=True)):
                            key = (t, int(leaf), int(code) // width - 1, int(code) % width - 1)
                            found[key] = found.get(key, 0) + int(n)

                    _walk(tree, matrix, free, add)
            columns = list(zip(*[(*k, n) for k, n in found.items()])) or [[]] * 5
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "leaf", "f", "g", "n"])

        return count

    out = None
    for chunk in chunks:
        part = x.mapInArrow(counter(chunk), "tree int, leaf int, f int, g int, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tree", "leaf", "f", "g").agg(F.sum("n").alias("n"))


def leaf_ranges(paths: DataFrame, cls: int = 0) -> DataFrame:
    """tree, leaf, feature, lo, hi, worth: values of the feature in (lo, hi] may come to the leaf; worth is its part of the prediction."""
    worth = (F.get("values", F.lit(cls)) * F.col("share")).alias("worth")
    steps = paths.select("tree", "leaf", worth, F.explode("steps").alias("s"))
    lo = F.max(F.when(F.col("s.right"), F.col("s.threshold")))
    hi = F.min(F.when(~F.col("s.right"), F.col("s.threshold")))
    edge = F.lit(float("inf"))
    return steps.groupBy("tree", "leaf", F.col("s.feature").alias("feature")).agg(
        F.coalesce(lo, -edge).alias("lo"), F.coalesce(hi, edge).alias("hi"), F.first("worth").alias("worth")
    )


def _inside(x: str, lo: str, hi: str) -> Column:
    return ((F.col(x) > F.col(lo)) & (F.col(x) <= F.col(hi))).cast("double")


def _prepared(model: PipelineModel, df: DataFrame, features: Sequence[str], free: int, cls: int):
    """Stored branch counts and leaf ranges, and one row with the number of rows and their summed prediction."""
    nodes = cut_lineage(node_table(model))
    paths = leaf_paths(nodes)
    counts = cut_lineage(branch_counts(df, features, nodes, free))
    ranges = cut_lineage(leaf_ranges(paths, cls))
    whole = counts.where("f = -1").select("tree", "leaf", F.col("n").alias("n0"))
    worths = paths.select("tree", "leaf", (F.get("values", F.lit(cls)) * F.col("share")).alias("worth"))
    total = whole.join(worths, ["tree", "leaf"]).agg(
        F.sum(F.when(F.col("tree") == 0, F.col("n0"))).alias("rows"), F.sum(F.col("n0") * F.col("worth")).alias("sum")
    )
    one = counts.where("f >= 0 AND g = -1").select("tree", "leaf", F.col("f").alias("feature"), F.col("n").alias("n1"))
    zero = F.lit(0).cast("long")
    singles = ranges.join(whole, ["tree", "leaf"], "left").join(one, ["tree", "leaf", "feature"], "left")
    singles = singles.withColumn("n0", F.coalesce("n0", zero)).withColumn("n1", F.col("n0") + F.coalesce("n1", zero))
    return counts, cut_lineage(singles), cut_lineage(total)


def partial_dependence(
    model: PipelineModel, df: DataFrame, features: Sequence[str], grid: DataFrame, cls: int = 0
) -> DataFrame:
    """feature, point, value, mean_prediction for the (feature, point, value) rows of ``grid``.

    The mean over all rows of ``df`` of what the model predicts with the feature set to the value; rows
    are read once, however many features and points are asked for.
    """
    _, singles, total = _prepared(model, df, features, 1, cls)
    number = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    asked = F.broadcast(grid.withColumn("f", number[F.col("feature")]))
    met = singles.join(asked.select("f", "feature", "point", "value"), (singles["feature"] == asked["f"])).drop(singles["feature"])
    change = F.col("worth") * (_inside("value", "lo", "hi") * F.col("n1") - F.col("n0"))
    sums = met.groupBy("feature", "point").agg(F.sum(change).alias("change"))
    out = grid.join(sums, ["feature", "point"], "left").join(F.broadcast(total), how="left")
    return out.select("feature", "point", "value", ((F.col("sum") + F.coalesce("change", F.lit(0.0))) / F.col("rows")).alias("mean_prediction"))


def even_grid(df: DataFrame, targets: Sequence[str], points: int = 20, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """feature, point, value: values evenly from the exact ``low`` to the exact ``high`` quantile of each target."""
    edges = column_quantile_rows(df, targets, [low, high], ["lo", "hi"])
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1)))
    return edges.select(F.col("column_name").alias("feature"), at.alias("point", "value"))


def interactions(
    model: PipelineModel, df: DataFrame, features: Sequence[str], grid: DataFrame, top: int | None = 12, cls: int = 0
) -> DataFrame:
    """f1, f2, interaction, share: pairs by how far their joint dependence is from the sum of the single ones.

    ``interaction`` is the root mean square, over the pairs of the two features' ``grid`` values, of joint
    dependence minus both single ones plus the mean; ``share`` is its part of the joint dependence's own spread.
    Pairs that share no path have none and are left out.
    """
    counts, singles, total = _prepared(model, df, features, 2, cls)
    two = counts.where("g >= 0").select("tree", "leaf", "f", "g", F.col("n").alias("n2"))
    a = singles.select("tree", "leaf", F.col("feature").alias("f"), F.col("lo").alias("lo_f"), F.col("hi").alias("hi_f"), F.col("n1").alias("n_f"), "n0", "worth")
    b = singles.select("tree", "leaf", F.col("feature").alias("g"), F.col("lo").alias("lo_g"), F.col("hi").alias("hi_g"), F.col("n1").alias("n_g"))
    both = a.join(b, ["tree", "leaf"]).where("f < g").join(two, ["tree", "leaf", "f", "g"], "left")
    both = both.withColumn("n_fg", F.col("n_f") + F.col("n_g") - F.col("n0") + F.coalesce("n2", F.lit(0).cast("long")))
    number = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    at = cut_lineage(grid.select(number[F.col("feature")].alias("f"), "point", F.col("value").alias("x")))
    points = at.join(at.select(F.col("f").alias("g"), F.col("point").alias("point_g"), F.col("x").alias("y")), F.col("f") < F.col("g"))
    pairs = both.select("f", "g").distinct()
    asked = points.join(F.broadcast(pairs), ["f", "g"])
    met = both.join(asked, ["f", "g"])
    x_in, y_in = _inside("x", "lo_f", "hi_f"), _inside("y", "lo_g", "hi_g")
    beyond = F.col("worth") * (x_in * y_in * F.col("n_fg") - x_in * F.col("n_f") - y_in * F.col("n_g") + F.col("n0"))
    cells = met.groupBy("f", "g", "point", "point_g").agg(F.sum(beyond).alias("d"))

    # The joint dependence is the two single ones plus what goes beyond them.
    met_one = singles.join(at, singles["feature"] == at["f"]).drop("feature")
    change = F.col("worth") * (_inside("x", "lo", "hi") * F.col("n1") - F.col("n0"))
    single = cut_lineage(met_one.groupBy("f", "point").agg(F.sum(change).alias("change")))
    cells = cells.join(F.broadcast(single.withColumnRenamed("change", "cf")), ["f", "point"])
    cells = cells.join(F.broadcast(single.select(F.col("f").alias("g"), F.col("point").alias("point_g"), F.col("change").alias("cg"))), ["g", "point_g"])
    cells = cells.join(F.broadcast(total), how="left").withColumns(
        {"d": F.col("d") / F.col("rows"), "joint": (F.col("cf") + F.col("cg") + F.col("d")) / F.col("rows")}
    )
    rms = F.sqrt(F.avg(F.col("d") * F.col("d")))
    names = F.array(*[F.lit(f) for f in features])
    out = cells.groupBy("f", "g").agg(rms.alias("interaction"), F.stddev_pop("joint").alias("spread"))
    out = out.select(
        F.get(names, F.col("f")).alias("f1"), F.get(names, F.col("g")).alias("f2"), "interaction",
        F.when(F.col("spread") > 0, F.col("interaction") / F.col("spread")).alias("share"),
    )
    return out if top is None else out.orderBy(F.desc("interaction"), "f1", "f2").limit(top)
