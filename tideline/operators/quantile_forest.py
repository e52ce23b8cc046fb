"""Conditional quantiles from a whole forest.

In each tree a row shares its leaf with training rows; their labels, weighted by one over the leaf's rows and averaged over the
trees, are the distribution of the row's label. Its q-quantile is the least training label whose cumulative weight
reaches q. The weights of a row run over all its leaves, which together may hold most of the training rows, so
they are not gathered: labels are cut into ``bins`` ranges of even size, a leaf is a short histogram, and these
say in which range a quantile lies. Only labels of that range, in the row's leaves, are then laid out one by one,
equal labels of a leaf as one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.models import VECTOR, _fit
from tideline.operators.trees import _small, leaves_of
from tideline.session import cut_lineage

#: Weights are sums of fractions; a sum this close to q counts as q.
CLOSE = 1e-12


def fit_quantile_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    qs: Sequence[float] = (0.1, 0.5, 0.9),
    trees: int = 100,
    depth: int = 10,
    min_rows: int = 20,
    bins: int = 128,
    seed: int = 42,
) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """``apply(rows, ids)`` gives ids and a column per quantile (q10, ...); ``ids`` must tell rows apart.

    Training rows without a label are left out. ``bins`` moves work only: a quantile is exact whatever their number.
    """
    learner = RandomForestRegressor(
        featuresCol=VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, subsamplingRate=1.0, seed=seed
    )
    used = train.where(F.col(label).isNotNull())
    model = _fit(used, features, learner)
    # The cuts are a sketch's: they need not be even, only the same everywhere.
    cuts = used.agg(F.percentile_approx(F.col(label).cast("double"), [i / bins for i in range(1, bins)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    y = F.col(label).cast("double")
    # Binary search would save little: bins are few and the comparison is a plain loop over a literal.
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("y"))) if cuts else F.lit(0)
    labels = leaves_of(model, used.withColumn("__y", y), ["__y"]).withColumnRenamed("__y", "y")
    labels = labels.groupBy("tree", "leaf", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("bin", place)
    sizes = labels.groupBy("tree", "leaf").agg(F.sum("c").alias("n"))
    weight = (F.col("c") / (F.col("n") * trees)).alias("w")
    labels = cut_lineage(labels.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "bin", "y", weight))
    histogram = _small(labels.groupBy("tree", "leaf", "bin").agg(F.sum("w").alias("w")))
    names = [f"q{round(q * 100)}" for q in qs]
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in zip(names, qs)])

    def apply(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
        key = F.struct(*ids).alias("id")  # fields of a struct compare null-safe
        leaves = cut_lineage(leaves_of(model, rows.withColumn("__id", key), ["__id"]).withColumnRenamed("__id", "id"))
        met = leaves.join(histogram, ["tree", "leaf"]).groupBy("id", "bin").agg(F.sum("w").alias("w"))
        # A row has at most ``bins`` ranges.
        order = Window.partitionBy("id").orderBy("bin")
        upto = met.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        upto = upto.withColumn("last", F.lead("bin").over(order).isNull())
        spots = upto.select("id", "bin", (F.col("upto") - F.col("w")).alias("before"), "upto", "last", F.explode(wanted).alias("q")).select(
            "id", "bin", "before", "upto", "last", "q.name", "q.q"
        )
        reached = (F.col("upto") >= F.col("q") - CLOSE) | F.col("last")
        spots = spots.where(reached & ((F.col("before") < F.col("q") - CLOSE) | (F.col("before") <= 0)))
        first = spots.groupBy("id", "name", "q").agg(F.min_by(F.struct("bin", "before"), "bin").alias("s")).select("id", "name", "q", "s.*")
        each = leaves.join(first, "id").join(labels, ["tree", "leaf", "bin"])
        sums = each.groupBy("id", "name", "q", "before", "y").agg(F.sum("w").alias("w"))
        along = Window.partitionBy("id", "name").orderBy("y")
        ranked = sums.withColumn("upto", F.col("before") + F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        ranked = ranked.withColumn("last", F.lead("y").over(along).isNull())
        hit = ranked.where((F.col("upto") >= F.col("q") - CLOSE) | F.col("last"))
        found = hit.groupBy("id", "name").agg(F.min("y").alias("y"))
        wide = found.groupBy("id").agg(*[F.max(F.when(F.col("name") == n, F.col("y"))).alias(n) for n in names])
        return wide.select("id.*", *names)

    return apply
