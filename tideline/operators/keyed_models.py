"""One model per key for any number of keys, from sums per key.

A least-squares or logistic fit needs of its rows only sums of products: the Gram matrix of the features and their products with the
target. All keys are fitted in one job a round, whatever their number: an aggregate gives each key its
sums, a task solves the small systems of the keys it holds, and for logistic models the next round takes the new
coefficients to the rows. A key with a third of the rows is summed where its rows lie.

Features are scaled once over all complete rows, so a penalty means the same for every key. A key whose
system has no single solution (too few rows, a constant feature, no penalty) gets the one of least norm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage

#: Keys whose coefficients are sent to every executor; beyond, rows and coefficients meet by shuffle.
BROADCAST_KEYS = 100_000


def _scales(df: DataFrame, features: Sequence[str], label: str) -> tuple[list[float], list[float]]:
    row = df.na.drop(subset=[*features, label]).agg(*[F.avg(f) for f in features], *[F.stddev_pop(F.col(f).cast("double")) for f in features]).first()
    d = len(features)
    return [float(v or 0.0) for v in row[:d]], [float(v) if v else 1.0 for v in row[d:]]


def _inputs(features: Sequence[str], means: Sequence[float], scales: Sequence[float]) -> list[Column]:
    return [F.lit(1.0), *[(F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(features, means, scales)]]


def _ready(df: DataFrame, key: str, features: Sequence[str], label: str, weight: str | None, means, scales) -> DataFrame:
    """key as a struct (so null is a key), inputs x, label y and weight w of the complete rows."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(
        F.struct(F.col(key).alias("key")).alias("k"), F.array(*_inputs(features, means, scales)).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w")
    )
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0))


def _sums(d: int, product: Column, target: Column) -> list[Column]:
    """Upper triangle of the weighted Gram matrix, then the products with the target."""
    x = [F.get("x", F.lit(i)) for i in range(d)]
    gram = [F.sum(product * x[i] * x[j]) for i in range(d) for j in range(i, d)]
    return [F.array(*gram).alias("gram"), F.array(*[F.sum(target * v) for v in x]).alias("cross")]


def _matrices(batch: pa.RecordBatch, d: int, penalty: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices, penalised from the input ``first`` on, and products with the target."""
    flat = batch.column("gram").flatten().to_numpy(zero_copy_only=False).reshape(-1, d * (d + 1) // 2)
    h = np.zeros((len(batch), d, d))
    upper = np.triu_indices(d)
    h[:, upper[0], upper[1]] = flat
    h[:, upper[1], upper[0]] = flat
    h[:, range(first, d), range(first, d)] += penalty
    return h, batch.column("cross").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _solutions(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """One system a row; least-norm where it is singular."""
    return np.einsum("kij,kj->ki", np.linalg.pinv(h, rcond=1e-12, hermitian=True), g)


def _coefficients(df: DataFrame, key: str, features: Sequence[str], means, scales, *others: str) -> DataFrame:
    """Back on the features' own scale: key, intercept and one column a feature."""
    b = [F.get("b", F.lit(i)) for i in range(len(features) + 1)]
    slopes = [c / F.lit(s) for c, s in zip(b[1:], scales)]
    shift = b[0]
    for c, m in zip(slopes, means):
        shift = shift - c * F.lit(m)
    return df.select(F.col("k.key").alias(key), *others, shift.alias("intercept"), *[c.alias(f) for c, f in zip(slopes, features)])


def fit_linear_per_key(
    df: DataFrame, key: str, features: Sequence[str], label: str, weight: str | None = None, penalty: float = 0.0
) -> DataFrame:
    """key, n, intercept and a coefficient per feature: weighted least squares with a ridge penalty on all but the intercept, one job.

    Rows with a missing feature or label are left out; a key of such rows only gets no model. The null key is a key.
    """
    means, scales = _scales(df, features, label)
    d = len(features) + 1
    rows = _ready(df, key, features, label, weight, means, scales)
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *_sums(d, F.col("w"), F.col("w") * F.col("y")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _solutions(*_matrices(batch, d, penalty, 1))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array(list(b), pa.list_(pa.float64()))], names=["k", "n", "b"])

    kind = dict(df.dtypes)[key]
    solved = sums.mapInArrow(solve, f"k struct<key: {kind}>, n long, b array<double>")
    return _coefficients(solved, key, features, means, scales, "n")


def fit_logistic_per_key(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    weight: str | None = None,
    penalty: float = 1.0,
    rounds: int = 30,
    close: float = 1e-8,
) -> DataFrame:
    """key, n, rounds, settled, intercept and a coefficient per feature: logistic models with a ridge penalty.

    Newton's method for all keys at once; a step that raises a key's loss is halved. A key rests when its
    step falls below ``close``, and only rows of the others are read on; after ``rounds`` jobs the rest is given as it is,
    with ``settled`` false. The penalty, on the intercept too, must be positive: a key with one class only has no other finite model.
    """
    if penalty <= 0:
        raise ValueError("logistic models per key need a positive penalty")
    means, scales = _scales(df, features, label)
    d = len(features) + 1
    kind = dict(df.dtypes)[key]
    rows = cut_lineage(_ready(df, key, features, label, weight, means, scales))
    zero = F.array(*[F.lit(0.0)] * d)
    fields = "b array<double>, loss double, trial array<double>, rounds int, settled boolean"
    state = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(
        "k", "n", zero.alias("b"), F.lit(float("inf")).alias("loss"), zero.alias("trial"), F.lit(0).alias("rounds"), F.lit(False).alias("settled")
    )
    state = cut_lineage(state)
    small = state.count() <= BROADCAST_KEYS

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            trial, b = column("trial"), column("b").copy()
            h, g = _matrices(batch, d, penalty, 0)
            g = g - penalty * trial
            now = batch.column("now").to_numpy() + penalty / 2 * (trial**2).sum(axis=1)
            loss = batch.column("loss").to_numpy(zero_copy_only=False).copy()
            better = now <= loss + 1e-12 * np.abs(now)
            step = np.where(better[:, None], _solutions(h, g), (trial - b) / 2)
            b[better], loss[better] = trial[better], now[better]
            base = np.where(better[:, None], trial, b)
            settled = np.abs(step).max(axis=1) < close
            as_list = lambda m: pa.array(list(m), pa.list_(pa.float64()))
            turns = pa.array(batch.column("rounds").to_numpy() + 1, pa.int32())
            columns = [batch.column("k"), batch.column("n"), as_list(b), pa.array(loss), as_list(base + step), turns, pa.array(settled)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "b", "loss", "trial", "rounds", "settled"])

    resting = None
    for _ in range(rounds):
        known = state.select("k", "trial")
        met = rows.join(F.broadcast(known) if small else known, "k")
        dot = F.aggregate(F.zip_with("x", "trial", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        p = 1 / (1 + F.exp(-F.col("dot")))
        # log(1 + e^t) without overflow.
        soft = F.greatest(F.col("dot"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("dot")))
        each = met.withColumn("dot", dot).withColumns({"p": p, "soft": soft})
        lost = F.sum(F.col("w") * (F.col("soft") - F.col("y") * F.col("dot"))).alias("now")
        sums = each.groupBy("k").agg(lost, *_sums(d, F.col("w") * F.col("p") * (1 - F.col("p")), F.col("w") * (F.col("y") - F.col("p"))))
        after = state.join(sums, "k").mapInArrow(advance, f"k struct<key: {kind}>, n long, {fields}")
        after = cut_lineage(after)
        done = after.where("settled")
        resting = done if resting is None else resting.unionByName(done)
        state = after.where("NOT settled")
        if state.isEmpty():
            break
    return _coefficients(resting.unionByName(state), key, features, means, scales, "n", "rounds", "settled")


def score_per_key(df: DataFrame, models: DataFrame, key: str, features: Sequence[str], name: str, link: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with the value of its key's model, null for a key without one; ``link`` maps the linear value."""
    packed = models.select(F.col(key).alias("__key"), F.struct("intercept", *features).alias("__m"))
    met = df.join(packed, F.col(key).eqNullSafe(F.col("__key")), "left")
    value = F.col("__m.intercept")
    for f in features:
        value = value + F.col(f).cast("double") * F.col("__m").getField(f)
    return met.withColumn(name, value if link is None else link(value)).drop("__key", "__m")


def logistic(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))
