"""What a fitted model reacts to: permutation, interaction, partial dependence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.models import score
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.ranking import hash_rank


def _permuted(sample: DataFrame, groups: Sequence[tuple[str, ...]], features: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """The sample once per feature group, that group's values taken from another row.

    Row ranks in two hash orders are joined, which pairs each row with one other row.
    """
    base = hash_rank(sample, ids, seed, name="__r")
    other = hash_rank(sample.select(*ids, *features), ids, f"{seed}-donor", name="__r").select(
        "__r", *[F.col(f).alias(f"__o_{f}") for f in features]
    )
    paired = base.join(other, "__r").drop("__r")
    labels = F.array(F.lit("(none)"), *[F.lit(" x ".join(g)) for g in groups])
    wide = paired.withColumn("__group", F.explode(labels))
    new = {}
    for f in features:
        mine = [" x ".join(g) for g in groups if f in g]
        new[f] = F.when(F.col("__group").isin(*mine), F.col(f"__o_{f}")).otherwise(F.col(f)) if mine else F.col(f)
    return wide.withColumns(new).drop(*[f"__o_{f}" for f in features])


def permutation_importance(
    model: PipelineModel,
    sample: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    loss: Column,
    groups: Sequence[tuple[str, ...]] | None = None,
    by: Sequence[str] = (),
    prob: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rise of the mean loss when a feature's values are shuffled, one row per feature.

    ``loss`` is an expression over the scored rows (``prediction`` or ``p_1``);
    ``by`` splits the rows, e.g. by true class.  All features are scored in one pass.
    """
    groups = list(groups or [(f,) for f in features])
    copies = _permuted(sample, groups, features, ids, seed)
    scored = score(model, copies, prob=prob, pred="prediction_value")
    means = scored.groupBy(*by, F.col("__group").alias("feature")).agg(F.avg(loss).alias("__loss"))
    whole = means.where(F.col("feature") == "(none)").select(*by, F.col("__loss").alias("__base"))
    rows = means.where(F.col("feature") != "(none)")
    joined = rows.join(F.broadcast(whole), list(by)) if by else rows.join(F.broadcast(whole), how="left")
    return joined.select(*by, "feature", (F.col("__loss") - F.col("__base")).alias("importance"))


def pair_interaction(
    model: PipelineModel,
    sample: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    loss: Column,
    top: int = 12,
    prob: str | None = None,
    among: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs whose joint shuffle costs most beyond their single shuffles.

    ``among`` limits the pairs to chosen features (the report lists ``top`` pairs).
    """
    chosen = list(among or features)
    pairs = list(combinations(chosen, 2))
    groups = [(f,) for f in chosen] + pairs
    imp = permutation_importance(model, sample, features, ids, loss, groups=groups, prob=prob)
    names = sample.sparkSession.createDataFrame([(" x ".join(p), *p) for p in pairs], "feature string, f1 string, f2 string")
    joint = F.broadcast(names).join(imp, "feature")
    one = F.broadcast(imp.select(F.col("feature").alias("f1"), F.col("importance").alias("__i1")))
    two = F.broadcast(imp.select(F.col("feature").alias("f2"), F.col("importance").alias("__i2")))
    out = joint.join(one, "f1").join(two, "f2")
    return (
        out.select("f1", "f2", (F.col("importance") - F.col("__i1") - F.col("__i2")).alias("interaction"))
        .orderBy(F.abs("interaction").desc(), "f1", "f2")
        .limit(top)
    )


def partial_dependence(
    model: PipelineModel, df: DataFrame, targets: Sequence[str], points: int = 20, prob: str | None = None
) -> DataFrame:
    """Mean prediction with one feature set to each of ``points`` values.

    The values run evenly from the feature's 5 % to its 95 % quantile.  Rows are
    repeated per point by an explode and averaged in the same stage.
    """
    out = None
    for f in targets:
        edges = exact_quantiles(df, f, [0.05, 0.95], names=["__lo", "__hi"])
        step = (F.col("__hi") - F.col("__lo")) / (points - 1)
        grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("__lo") + i * step)
        rows = df.join(F.broadcast(edges), how="left").select("*", F.posexplode(grid).alias("__i", "__x"))
        scored = score(model, rows.withColumn(f, F.col("__x")), prob=prob, pred="prediction_value")
        value = F.col(f"{prob}_1") if prob else F.col("prediction_value")
        part = scored.groupBy(F.lit(f).alias("feature"), F.col("__i").alias("point")).agg(
            F.first("__x").alias("value"), F.avg(value).alias("mean_prediction")
        )
        out = part if out is None else out.unionByName(part)
    return out


def tree_importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Split-gain importances of a fitted tree model as (feature, importance) rows."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, values)), "feature string, importance double")
