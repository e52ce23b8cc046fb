"""Principal components and whitening of embeddings by shifted CholeskyQR.

Every entry c becomes the integer floor(256 c). Each distinct integer vector stands once in the fit list, which is
written; its count and its sums are exact integers. The centred rows X of the fit list are then orthogonalised without
ever leaving the tasks: a pass sums the Gram matrix of its rows, the driver factors that matrix as R'R, and the next pass
first solves q R = x for each of its rows. The first factor is taken of the Gram matrix plus a small multiple of the
identity, so that it exists however close to dependent the columns are; later ones need that seldom. Passes go on until
the Gram matrix is the identity. The product of the factors is then the R of X = QR, and its singular values and right
singular vectors are those of X, found without squaring its condition: the components and n times their variances.

What meets the driver is one Gram matrix (dimensions squared); what a task holds is one Arrow batch and one such matrix.
A vector that is repeated in a third of the rows collapses before the shuffle.

Edge cases: rows whose vector is null, empty or holds a null, NaN or infinite entry give nothing. So do vectors of another
length than most distinct vectors have (of two equally common lengths, the longer counts). A component whose variance is zero,
or is rounding noise, cannot be whitened and is left out; so a table of one distinct vector, like an empty one, gives no
rows. Repeated rows give a row each, null keys too. A deviation that no long holds is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash

SCALE = 256
#: Most factors; two or three suffice unless columns are dependent.
PASSES = 6
#: Largest entry of the Gram matrix minus the identity that counts as orthogonal.
CLOSE = 1e-12
#: Singular values below this share of the largest are zero but for rounding.
NOISE = 1e-11
LARGEST_LONG = 2**63 - 1


def integers(vector: Column) -> Column:
    """Entries as integers; null for a vector that takes no part."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.when(usable & (F.size(vector) > 0), steps)


def matrices(batches: Iterator[pa.RecordBatch], dims: int, column: str = "x") -> Iterator[np.ndarray]:
    """The integer vectors of each Arrow batch as rows."""
    for batch in batches:
        if len(batch):
            yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def column_sums(x: np.ndarray) -> list[int]:
    """Exact column sums of 64-bit integers, by halves that cannot overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(lo) for h, lo in zip(high, low)]


@dataclass(frozen=True)
class FitList:
    """Distinct vectors, their count n and their sum in each dimension."""

    vectors: DataFrame
    n: int
    sums: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def fit_list(rows: DataFrame) -> FitList:
    """``rows`` have an integer vector x each; vectors of an uncommon length are left out."""
    distinct = stash(rows.select("x").distinct(), "whitening-fit").withColumn("d", F.size("x"))
    common = distinct.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return FitList(distinct.select("x"), 0, [])
    dims = common["d"]
    vectors = distinct.where(F.col("d") == dims).select("x")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = [0] * dims
        for x in matrices(batches, dims):
            s = [a + b for a, b in zip(s, column_sums(x))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["i", "s"]
        )

    sums = vectors.mapInArrow(totals, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return FitList(vectors, common["count"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])])


def solved(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows y with y r = q for an upper triangular r, one column after the other."""
    out = np.empty_like(q)
    for j in range(r.shape[0]):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: FitList, of_rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of y'y over the rows y that ``of_rows`` makes of centred vectors; one partial matrix a task."""
    dims, mean = fit.dims, fit.mean

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for x in matrices(batches, dims):
            y = of_rows(x - mean)
            g += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "row"]
        )

    parts = fit.vectors.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    total = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    return (total + total.T) / 2


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = g, or g plus the shift that makes it definite."""
    d = len(g)
    norm = np.linalg.norm(g, 2)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * norm
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:  # rounding outweighs the shift
            shift = 10 * shift


def triangular(fit: FitList) -> np.ndarray:
    """An R with R'R = X'X for the centred rows X of the fit list."""
    d = fit.dims
    factors: list[np.ndarray] = []
    composed = np.eye(d)

    def orthogonal(x: np.ndarray) -> np.ndarray:
        for r in factors:
            x = solved(x, r)
        return x

    g = gram(fit, orthogonal, d)
    while len(factors) < PASSES and np.abs(g).max() > 0 and np.abs(g - np.eye(d)).max() > CLOSE:
        factors.append(factor(g, fit.n, shifted=not factors))
        composed = factors[-1] @ composed
        g = gram(fit, orthogonal, d)
    # What is left of the last Gram matrix, its root even if columns are dependent.
    values, vectors = np.linalg.eigh(g)
    return (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) @ composed


@dataclass(frozen=True)
class Whitening:
    """Components as columns with the variance and the share of the trace of each."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def train(fit: FitList, components: int) -> Whitening:
    """The first components of the fit list and how far whitened rows are from unit covariance."""
    _, singular, right = np.linalg.svd(triangular(fit))
    keep = int((singular > NOISE * singular[0]).sum()) if singular[0] > 0 else 0
    k = min(components, keep)
    axes = right[:k].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])  # the largest entry is positive
    variances = singular**2 / fit.n
    scale = np.sqrt(variances[:k])
    # The column of ones gives the sums of the whitened rows beside their products.
    sums = gram(fit, lambda x: np.column_stack([x @ axes / scale, np.ones(len(x))]), k + 1) / fit.n
    covariance = sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k])
    error = float(np.abs(covariance - np.eye(k)).max()) if k else 0.0
    return Whitening(fit.n, fit.sums, axes, variances[:k], variances[:k] / variances.sum() if k else variances[:0], error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S) squared; None beyond a long."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    wide = x.shape[1] * largest * largest > LARGEST_LONG
    off = n * (x.astype(object) if wide else x) - np.array(sums, dtype=object if wide else np.int64)
    return [v if v <= LARGEST_LONG else None for v in map(int, (off * off).sum(axis=1))]


def whiten(df: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    rows = df.select(F.col(key).alias("vec_id"), integers(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_list(rows)
    model = train(fit, components) if fit.n else None
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    dims, mean, k = fit.dims, fit.mean, len(model.variances)
    scale = np.sqrt(model.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in matrices([batch], dims):
                m = len(x)
                values = (x - mean) @ model.components / scale
                deviation = pa.array(deviations(x, model.n, model.sums), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    deviation.take(each),
                    pa.array(values.reshape(-1)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.where(F.size("x") == dims).mapInArrow(project, schema)
