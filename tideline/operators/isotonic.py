"""Isotonic regression of any number of rows, fitted and applied without gathering them.

The fit is the pooling of adjacent violators: neighbours whose means fall are merged until means rise. Merging gives the same
blocks in whatever order it is done, so it can start anywhere:

1. Rows collapse to distinct scores (weight and weighted label sum), so ties cannot crowd a task.
2. Scores are cut into even ranges, in order; each task pools its range. Only blocks are written.
3. The blocks of a group, if they are few (``AT_ONCE``), are pooled in one task.
4. If they are many, the group is cut first. In the plane of cumulative weight and cumulative sum the fit is the lower convex
   hull, and the point that is lowest along a slope m is a corner of it: no block reaches across such a point. One aggregate finds it
   for many slopes. Between two corners only slopes between theirs can occur, so in each range all blocks with
   lower means merge, all with higher ones too, and each stretch is pooled in a task of its own.

The result is a table of blocks (lowest and highest score, value, weight). ``apply_isotonic`` reads it as a broken line
through both ends of each block, flat beyond the first and last: knots lie in cells of ``CELL``, a row finds its
cell by bisection of the cells' first scores, then its place by bisection of the cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage

#: Blocks of a group that one task may pool.
AT_ONCE = 100_000
#: Knots of the fitted line in one cell; cells that are sent to every executor.
CELL, BROADCAST_CELLS = 128, 20_000
_BLOCK = "part int, lo double, hi double, w double, s double"


def pooled(lo: list[float], hi: list[float], w: list[float], s: list[float]) -> list[tuple[float, float, float, float]]:
    """Blocks in order of score, merged until their means s / w rise strictly."""
    out: list[tuple[float, float, float, float]] = []
    for a, b, x, y in zip(lo, hi, w, s):
        while out and out[-1][3] * x >= y * out[-1][2]:
            before = out.pop()
            a, x, y = before[0], x + before[2], y + before[3]
        out.append((a, b, x, y))
    return out


def _columns(blocks: list[tuple[float, float, float, float]]) -> list[pa.Array]:
    return [pa.array(c, pa.float64()) for c in zip(*blocks)] if blocks else [pa.array([], pa.float64())] * 4


def _pool_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool each run of equal (group, part) in a partition that is sorted by group and score."""
    run, held = None, []

    def done() -> pa.RecordBatch:
        blocks = pooled(*[[b[i] for b in held] for i in range(4)])
        group, part = run
        names = ["g", "part", "lo", "hi", "w", "s"]
        return pa.RecordBatch.from_arrays(
            [pa.array([group] * len(blocks), pa.string()), pa.array([part] * len(blocks), pa.int32()), *_columns(blocks)], names=names
        )

    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("g", "part", "lo", "hi", "w", "s")])
        for group, part, *block in rows:
            if run != (group, part):
                if held:
                    yield done()
                run, held = (group, part), []
            held.append(block)
            if len(held) > AT_ONCE:
                held = pooled(*[[b[i] for b in held] for i in range(4)])
    if held:
        yield done()


def _stretches(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blocks of large groups with the stretch each lies in, merged where no corner can be.

    ``sizes`` has one row per large group, with its number of blocks.
    """
    mean = F.col("s") / F.col("w")
    parts = 2 * F.ceil(F.col("n") / AT_ONCE)
    spread = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: i / parts)
    ours = blocks.join(sizes, "g")
    # Slopes that cut the blocks evenly: the means' quantiles, thinned to as many as the group needs.
    probes = ours.groupBy("g").agg(F.percentile_approx(mean, [i / 1000 for i in range(1, 1000)], 10_000).alias("q"), F.max("n").alias("n"))
    slopes = probes.select("g", F.array_sort(F.array_distinct(F.transform(spread, lambda x: F.get("q", F.least(F.floor(x * 1000), F.lit(998)).cast("int"))))).alias("slopes"))

    before_part = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ours.groupBy("g", "part").agg(F.sum("w").alias("pw"), F.sum("s").alias("ps"))
    totals = totals.select("g", "part", *[F.coalesce(F.sum(c).over(before_part), F.lit(0.0)).alias(c) for c in ("pw", "ps")])
    inside = Window.partitionBy("g", "part").orderBy("lo")
    placed = ours.join(totals, ["g", "part"]).join(slopes, "g").select(
        "g", "part", "lo", "hi", "w", "s", "slopes", mean.alias("m"),
        (F.col("pw") + F.sum("w").over(inside)).alias("cw"), (F.col("ps") + F.sum("s").over(inside)).alias("cs"),
        F.lead(mean).over(inside).alias("after"), F.lag(mean).over(inside).alias("before"),
    )
    placed = cut_lineage(placed)

    # The lowest point of a range along a slope lies where the range's means pass it: one row a range and slope.
    ends = placed.select(
        "g", "cw", "cs", F.explode(F.filter("slopes", lambda m: (F.col("m") <= m) & (F.col("after").isNull() | (m < F.col("after"))))).alias("m")
    )
    starts = placed.where(F.col("before").isNull()).select(
        "g", (F.col("cw") - F.col("w")).alias("cw"), (F.col("cs") - F.col("s")).alias("cs"), F.explode(F.filter("slopes", lambda m: m < F.col("m"))).alias("m")
    )
    lowest = ends.unionByName(starts).groupBy("g", "m").agg(F.min_by("cw", F.struct(F.col("cs") - F.col("m") * F.col("cw"), "cw")).alias("at"))
    corners = lowest.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("corners"))

    start = F.col("cw") - F.col("w")
    passed = F.filter("corners", lambda c: c["at"] <= start)
    ahead = F.filter("corners", lambda c: c["at"] > start)
    least, most = F.array_max(F.transform(passed, lambda c: c["m"])), F.array_min(F.transform(ahead, lambda c: c["m"]))
    zone = F.when(F.col("m") < least, F.lit(-1.0)).when(F.col("m") > most, F.lit(1.0)).otherwise(0.0)
    cut = placed.join(corners, "g").select(
        "g", "part", "lo", "hi", "w", "s", F.size(F.array_distinct(F.transform(passed, lambda c: c["at"]))).alias("stretch"), zone.alias("zone")
    )
    keep = F.when(F.col("zone") == 0, F.col("lo"))
    merged = cut.groupBy("g", "stretch", "part", "zone", keep.alias("own")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("w").alias("w"), F.sum("s").alias("s")
    )
    return merged.select("g", "stretch", "lo", "hi", "w", "s")


def _pool_group(table: pa.Table) -> pa.Table:
    ordered = table.sort_by("lo")
    blocks = pooled(*[ordered.column(c).to_pylist() for c in ("lo", "hi", "w", "s")])
    group = pa.array([table.column("g")[0].as_py()] * len(blocks), pa.string())
    return pa.Table.from_arrays([group, *_columns(blocks)], names=["g", "lo", "hi", "w", "s"])


def fit_isotonic(
    df: DataFrame, score: str, label: str, weight: str | None = None, by: Sequence[str] = (), rising: bool = True
) -> DataFrame:
    """Blocks of the best rising (or falling) step function per group: by..., lo, hi, value, weight.

    Rows without score or label (null or NaN) or without positive weight are left out; a group of such rows only has no block.
    """
    sign = 1.0 if rising else -1.0
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    used = df.select(group.alias("g"), *by, x.alias("x"), y.alias("y"), w.alias("w"))
    used = used.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0))
    points = used.groupBy("g", *by, "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y") * sign).alias("s"))
    points = cut_lineage(points)
    ordered = points.repartitionByRange("g", "x").sortWithinPartitions("g", "x")
    ranges = ordered.select("g", F.spark_partition_id().alias("part"), F.col("x").alias("lo"), F.col("x").alias("hi"), "w", "s")
    blocks = cut_lineage(ranges.mapInArrow(_pool_runs, f"g string, {_BLOCK}"))

    sizes = cut_lineage(blocks.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > AT_ONCE)
    todo = blocks.join(large, "g", "left_anti").withColumn("stretch", F.lit(0)).select("g", "stretch", "lo", "hi", "w", "s")
    if not large.isEmpty():
        todo = todo.unionByName(_stretches(blocks, large))
    final = todo.groupBy("g", "stretch").applyInArrow(_pool_group, "g string, lo double, hi double, w double, s double")
    names = points.select("g", *by).distinct() if by else None
    found = final.join(names, "g") if by else final
    value = F.col("s") / F.col("w") * sign
    return found.select(*by, "lo", "hi", (value + 0.0).alias("value"), F.col("w").alias("weight"))


def bisect(values: Column, x: Column, most: int) -> Column:
    """How many of the ascending values are at most x, in as many steps as ``most`` values need."""
    start = F.struct(F.lit(0).alias("a"), F.size(values).alias("b"))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["a"] + at["b"]) / 2).cast("int")
        low = F.get(values, middle) <= x
        moved = F.struct(F.when(low, middle + 1).otherwise(at["a"]).alias("a"), F.when(low, at["b"]).otherwise(middle).alias("b"))
        return F.when(at["a"] < at["b"], moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(max(most, 1).bit_length())), start, step, lambda at: at["a"])


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the fitted value at its score; null without a score, NaN score, or a group without blocks.

    ``blocks`` is what ``fit_isotonic`` gave for the same ``by``.
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    ends = F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("v")), F.struct(F.col("hi").alias("x"), F.col("value").alias("v")))
    knots = blocks.select(group.alias("__g"), F.explode(F.when(F.col("lo") < F.col("hi"), ends).otherwise(F.slice(ends, 1, 1))).alias("k"))
    knots = cut_lineage(knots.select("__g", "k.x", "k.v"))
    # Cells by rank: the knots of a group are ordered in ranges, and a range gives its cells.
    ordered = knots.repartitionByRange("__g", "x").withColumn("part", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    cell = F.floor((F.row_number().over(Window.partitionBy("__g", "part").orderBy("x")) - 1) / CELL)
    cells = ordered.withColumn("cell", cell).groupBy("__g", "part", "cell").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("knots"))
    across = Window.partitionBy("__g").orderBy(F.col("knots")[0]["x"])
    # One row per cell: its number, its knots and the first of the next cell.
    cells = cells.select("__g", F.row_number().over(across).alias("__cell"), "knots", F.lead(F.col("knots")[0]).over(across).alias("next"))
    cells = cells.withColumn("__knots", F.when(F.col("next").isNull(), F.col("knots")).otherwise(F.concat("knots", F.array("next"))))
    cells = cut_lineage(cells.select("__g", "__cell", "__knots", F.col("knots")[0]["x"].alias("x")))
    count = cells.count()
    firsts = cells.groupBy("__g").agg(F.array_sort(F.collect_list("x")).alias("__firsts"))
    many = count > BROADCAST_CELLS

    rows = df.withColumns({"__g": group, "__x": F.col(score).cast("double")})
    rows = rows.withColumn("__x", F.when(~F.isnan("__x"), F.col("__x")))
    same = F.col("__g").eqNullSafe(F.col("__fg"))
    firsts = firsts.withColumnRenamed("__g", "__fg")
    placed = rows.join(firsts if many else F.broadcast(firsts), same, "left")
    placed = placed.withColumn("__cell", F.greatest(bisect(F.col("__firsts"), F.col("__x"), count), F.lit(1))).drop("__firsts", "__fg")
    right = cells.select(F.col("__g").alias("__cg"), F.col("__cell").alias("__cc"), "__knots")
    met = placed.join(right if many else F.broadcast(right), F.col("__g").eqNullSafe(F.col("__cg")) & (F.col("__cell") == F.col("__cc")), "left")
    return met.withColumn(name, _line(F.col("__knots"), F.col("__x"))).drop("__g", "__x", "__cell", "__cg", "__cc", "__knots")


def _line(knots: Column, x: Column) -> Column:
    """The broken line through the knots at x, flat outside."""
    at = bisect(F.transform(knots, lambda k: k["x"]), x, CELL + 1)

    def between(i: Column) -> Column:
        a, b = F.get(knots, i - 1), F.get(knots, i)
        slope = (b["v"] - a["v"]) / (b["x"] - a["x"])
        inner = F.when(x == a["x"], a["v"]).otherwise(a["v"] + slope * (x - a["x"]))
        return F.when(i <= 0, b["v"]).when(i >= F.size(knots), a["v"]).otherwise(inner)

    return F.when(x.isNotNull(), F.get(F.transform(F.array(at), between), F.lit(0)))
