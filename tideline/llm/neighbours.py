"""Nearest neighbours by inner product from a forest of random-projection trees.

Each tree halves a sample of the vectors again and again: the direction between two random members of
a node, cut at the median. Every row then goes to its leaf in every tree. A query walks all trees with one
priority queue: the node that lies nearest on the wrong side of its cuts comes next, whichever tree it
is in, until ``probes`` leaves are reached. Queries and rows meet by leaf, scores are computed exactly on
the original vectors, and the best of all leaves are merged. A query carries the score of its last place among the sampled rows
in its leaves: a row below it cannot be in the result and is not handed on, and a task hands on each query's best once, not once a leaf.

How many leaves that takes is measured: the true neighbours of ``CHECKED`` queries are found by comparing them with all
rows, and ``probes`` is the least number of leaves that gives them a mean recall of ``RECALL``. Only a table
of a few leaves' rows is one leaf, and then the result is exact.

Inner products become distances by one more coordinate that gives every row the same length.
Only as many rows of equal vectors as a query can return (smallest ids) enter the index, and equal
queries search once, so copies cost nothing. A leaf with many rows or queries is cut into parts, and every
pair of parts is work of bounded size.

Bounds: trees are fitted on ``SAMPLE`` rows at most, chosen by hash; every row is indexed. The driver holds
``CHECKED`` queries with k neighbours each.

Edge cases: vectors that are null, zero, hold nulls, NaN or infinities, or are of another length than most, take no
part, as query or row. Rows with the id of the query count as its own. Fewer rows than k give all of them.
Ties go to the smaller id. Null ids take no part. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stash

SAMPLE = 20_000
#: Rows found (24 bytes each) that a task holds before it merges and, if they stay many, hands them on.
HELD = 1_000_000
#: Rows of a leaf or its queries that are compared at once.
PART = 4096
#: Queries whose true neighbours are looked up, and the share of these that the probes must find; above 0.9, as it is a sample.
CHECKED, RECALL = 128, 0.95


@dataclass
class Forest:
    depth: int
    normals: np.ndarray  # tree x inner node x coordinate, unit length
    cuts: np.ndarray  # tree x inner node
    radius: float  # length of the longest row

    @property
    def trees(self) -> int:
        return len(self.normals)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that levels their lengths."""
        rest = np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32) / np.float32(self.radius)

    def queries(self, x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.concatenate([x / length, np.zeros((len(x), 1))], 1).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        rows, out = self.rows(x), np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", rows, self.normals[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, tree and leaf of the ``count`` leaves that each query reaches first."""
        inner = (1 << self.depth) - 1
        flat = self.normals.reshape(-1, self.normals.shape[-1])
        margins = (self.queries(x) @ flat.T).reshape(len(x), self.trees, inner) - self.cuts
        found: tuple[list[int], list[int], list[int]] = ([], [], [])
        for q in range(len(x)):
            queue = [(0.0, t, 0) for t in range(self.trees)]
            left = count
            own = margins[q].tolist()
            while queue and left:
                cost, t, node = heapq.heappop(queue)
                cut = own[t]
                while node < inner:
                    m = cut[node]
                    near = 2 * node + 1 + (m > 0)
                    heapq.heappush(queue, (max(cost, abs(m)), t, 4 * node + 3 - near))
                    node = near
                left -= 1
                for column, value in zip(found, (q, t, node - inner), strict=True):
                    column.append(value)
        return tuple(np.array(c, np.int64) for c in found)


def fit(sample: np.ndarray, radius: float, trees: int, depth: int, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    forest = Forest(depth, np.zeros((trees, inner, sample.shape[1] + 1), np.float32), np.zeros((trees, inner), np.float32), radius)
    x = forest.rows(sample)
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for node in range(inner):
            own = members.pop(node)
            if len(own) > 1:
                a, b = x[rng.choice(own, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length > 0:
                    forest.normals[t, node] = normal / length
                    forest.cuts[t, node] = np.median(x[own] @ forest.normals[t, node])
            side = x[own] @ forest.normals[t, node] > forest.cuts[t, node]
            members[2 * node + 1], members[2 * node + 2] = own[~side], own[side]
    return forest


def positions(forest: Forest, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many leaves one query visits, in its order, until it meets each of the rows."""
    _, tree, leaf = forest.probes(query[None], forest.trees << forest.depth)
    order = np.zeros((forest.trees, 1 << forest.depth), np.int64)
    order[tree, leaf] = np.arange(1, len(tree) + 1)
    return order[np.arange(forest.trees), forest.leaves(rows)].min(1)


def probes_needed(forest: Forest, found: list[tuple[np.ndarray, np.ndarray]], recall: float = RECALL) -> int:
    """The least number of leaves with which the mean recall of (query, its true neighbours) reaches ``recall``."""
    at = np.concatenate([positions(forest, q, rows) for q, rows in found])
    weight = np.concatenate([np.full(len(rows), 1 / len(rows)) for _, rows in found])
    order = np.argsort(at, kind="stable")
    reached = np.cumsum(weight[order]) / weight.sum()
    return int(at[order][min(np.searchsorted(reached, recall - 1e-9), len(at) - 1)])


def usable(vector: Column) -> Column:
    """Not null, no part null or not finite, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _spread(forest, dim: int, count: int | None, k: int = 0):
    """Arrow batches (id, vec) to (tree, leaf, id, vec, bound): to all leaves of a row, or to ``count`` leaves of a query.

    ``forest`` holds the sample too; the bound of a query is the k-th best score among the sampled rows in its leaves, if ``k`` is given.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sample = forest.value
        own = trees.leaves(sample) + (np.arange(trees.trees, dtype=np.int32) << trees.depth) if k else None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                x = _matrix(batch.column("vec"), dim).astype(np.float64)
                bound = np.full(len(x), -np.inf)
                if count is None:
                    leaf = trees.leaves(x).ravel()
                    row, tree = np.divmod(np.arange(len(leaf)), trees.trees)
                else:
                    row, tree, leaf = trees.probes(x, count)
                    bound = _bounds(x, sample, own, row, (tree << trees.depth) + leaf, trees, k) if k else bound
                at = pa.array(row)
                columns = [pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), *(c.take(at) for c in batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bound[row])], names=["tree", "leaf", "id", "vec", "bound"])

    return spread


def _bounds(x: np.ndarray, sample: np.ndarray, own: np.ndarray, row: np.ndarray, leaf: np.ndarray, trees: Forest, k: int) -> np.ndarray:
    """What the k-th best row that each query meets scores at least; all of these rows are met, so none that counts is lost."""
    scores, out = x @ sample.T, np.full(len(x), -np.inf)
    slack = 1e-9 * np.sqrt((x * x).sum(1)) * trees.radius  # sums in another order
    for q in range(len(x)):
        visited = np.zeros(trees.trees << trees.depth, bool)
        visited[leaf[row == q]] = True
        met = scores[q, visited[own].any(1)]
        if len(met) >= k:
            out[q] = np.partition(met, -k)[-k] - slack[q]
    return out


def _best(dim: int, k: int):
    """Sorted Arrow batches (g, kind, id, vec, bound) to (query, vec_id, score): rows of a group come before its queries."""

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, vectors = None, [], []
        out: list[tuple] = []
        held = 0
        for batch in batches:
            g, kind, bound = (batch.column(c).to_numpy() for c in ("g", "kind", "bound"))
            own, x = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dim).astype(np.float64)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if s == e:
                    continue
                if g[s] != group:
                    group, ids, vectors = g[s], [], []
                if kind[s] == 0:
                    ids.append(own[s:e])
                    vectors.append(x[s:e])
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    found = list(_top(own[s:e], x[s:e], ids[0], vectors[0], k, bound[s:e]))
                    out += found
                    held += sum(len(f[0]) for f in found)
                    if held > HELD:
                        out = [_merged(out, k)]
                        held = len(out[0][0])
                        if held > HELD // 2:
                            yield batch_of(out[0])
                            out, held = [], 0
        if out:
            yield batch_of(_merged(out, k))

    return best


def _merged(found: list[tuple], k: int) -> list[np.ndarray]:
    """The k best different rows of each query."""
    query, own, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, own, query))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(query[order]) != 0) | (np.diff(own[order]) != 0)
    query, own, score = (c[order[first]] for c in (query, own, score))
    order = np.lexsort((own, -score, query))
    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
    return [query[order], own[order], score[order]]


def _top(query: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None):
    """The k best rows of each query, none below its bound."""
    for s in range(0, len(query), 256):
        scores = q[s : s + 256] @ x.T
        # Only what reaches the k-th best score of its query is put in order, ties included.
        least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
        if bound is not None:
            least = np.maximum(least, bound[s : s + 256, None])
        row, at = np.nonzero(scores >= least)
        score, own = scores[row, at], ids[at]
        order = np.lexsort((own, -score, row))
        first = np.searchsorted(row, np.arange(len(scores)))
        order = order[np.arange(len(row)) - first[row] < k]
        yield query[s : s + 256][row[order]], own[order], score[order]


def _all_best(asked, dim: int, k: int):
    """Arrow batches (id, vec) to (query, id, score, vec): the best rows of a task for each of the broadcast queries."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = asked.value
        kept: list[tuple] | None = None
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("vec"), dim).astype(np.float64)
            if not len(ids):
                continue
            found = [np.concatenate(c) for c in zip(*_top(np.arange(len(queries)), q, ids, x, k), strict=True)]
            place = np.argsort(ids, kind="stable")
            vectors = x[place[np.searchsorted(ids, found[1], sorter=place)]]
            mine = [*found, vectors]
            if kept is not None:
                mine = [np.concatenate(c) for c in zip(kept, mine, strict=True)]
            order = np.lexsort((mine[1], -mine[2], mine[0]))
            number = mine[0][order]
            first = np.searchsorted(number, np.arange(len(queries)))
            order = order[np.arange(len(number)) - first[number] < k]
            kept = [c[order] for c in mine]
        if kept is not None:
            vec = pa.FixedSizeListArray.from_arrays(pa.array(kept[3].ravel()), dim).cast(pa.list_(pa.float64()))
            columns = [pa.array(queries[kept[0]]), pa.array(kept[1]), pa.array(kept[2]), vec]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score", "vec"])

    return best


def true_neighbours(distinct: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of the k best rows of a few queries, the query's own id left out, found in all rows."""
    asked = distinct.sparkSession.sparkContext.broadcast((ids, q))
    found = distinct.mapInArrow(_all_best(asked, q.shape[1], k + 1), "query long, id long, score double, vec array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = found.where("id <> query").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    rows: dict[int, list] = {}
    for r in near.select("query", "vec").collect():
        rows.setdefault(r[0], []).append(r[1])
    return [(x, np.array(rows[int(i)])) for i, x in zip(ids, q, strict=True) if int(i) in rows]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 16, probes: int | None = None, leaf_rows: int = 256,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows found for each query, its own id left out.

    ``queries`` has the columns of ``vectors``. ``probes`` is how many leaves of about ``leaf_rows`` rows a
    query visits over all trees; more find more. If left out, it is measured on a fixed set of the queries.
    """
    spark = vectors.sparkSession
    x = F.col(vector)

    def taken(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(key).isNotNull() & usable(x)).select(F.col(key).cast("long").alias("id"), x.alias("vec"))
        return rows.withColumns({"e1": F.xxhash64("vec"), "e2": F.xxhash64(F.lit(1), "vec")})

    rows = taken(vectors)
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").take(1)
    if not lengths:
        empty = "query_id long, rank int, vec_id long, score double"
        return spark.createDataFrame([], empty)
    dim = lengths[0]["dim"]
    rows = rows.where(F.size("vec") == dim)
    asked = taken(queries).where(F.size("vec") == dim)
    copies = Window.partitionBy("e1", "e2", "vec").orderBy("id")
    distinct = stash(
        rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vec"), "vectors"
    )
    longest = F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, square = distinct.agg(F.count(F.lit(1)), longest).first()
    share = min(1.0, SAMPLE / n)
    drawn = distinct.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1_000_000)) < share * 1_000_000) if share < 1 else distinct
    sample = np.array([r[0] for r in drawn.select("vec").limit(2 * SAMPLE).collect()], np.float64).reshape(-1, dim)
    most = max(len(sample) // 16, 1)
    depth = 0 if n <= 4 * leaf_rows else int(np.log2(min(n / leaf_rows, most)))
    named = asked.groupBy("e1", "e2").agg(F.min("id").alias("first"))
    named = stash(asked.select("id", "e1", "e2").join(named, ["e1", "e2"]).select(F.col("id").alias("query_id"), "first"), "queries")
    firsts = named.select(F.col("first").alias("id")).distinct()
    once = asked.select("id", "vec").join(firsts, "id", "left_semi").dropDuplicates(["id"])
    asks = once.count() if depth and probes is None else 0
    fitted = fit(sample, float(np.sqrt(square)), trees if depth else 1, depth)
    if asks and depth:
        some = once.orderBy(F.xxhash64("id"), "id").limit(CHECKED).collect()
        ids, x = np.array([r["id"] for r in some]), np.array([r["vec"] for r in some], np.float64)
        probes = probes_needed(fitted, true_neighbours(distinct, ids, x, k))
    probes = probes or 1
    forest = spark.sparkContext.broadcast((fitted, sample))
    kind = vectors.schema[vector].dataType.simpleString()
    schema = f"tree int, leaf int, id long, vec {kind}, bound double"
    placed = distinct.mapInArrow(_spread(forest, dim, None), schema)
    probing = once.mapInArrow(_spread(forest, dim, probes, k + 1), schema)

    leaf = ["tree", "leaf"]
    # One row for each leaf of the forest: at most trees * SAMPLE / 16.
    parts = stash(
        placed.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("row_parts"))
        .join(once.mapInArrow(_spread(forest, dim, probes), schema).groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("query_parts")), leaf),
        "leaves",
    )
    sides = []
    for number, (side, own, other) in enumerate(((placed, "row_parts", "query_parts"), (probing, "query_parts", "row_parts"))):
        met = side.join(F.broadcast(parts), leaf)
        met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ["own", "other"] if number == 0 else ["other", "own"]
        sides.append(met.select(F.xxhash64(*leaf, *pair).alias("g"), F.lit(number).alias("kind"), "id", "vec", "bound"))
    work = sides[0].union(sides[1]).repartition("g").sortWithinPartitions("g", "kind")
    found = work.mapInArrow(_best(dim, k + 1), "query long, vec_id long, score double")
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    each = named.join(best, F.col("first") == F.col("query")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
