"""SimHash fingerprints, and groups of near-duplicate texts by bit-sliced comparison.

Equal fingerprints collapse to one. Two that differ in at most three bits agree on two of five blocks of
bits at least, so each distinct fingerprint goes to the ten groups that its pairs of blocks name, and only
a group's members are compared. Members are stored as bit planes: one machine word holds one bit of
64 fingerprints. Adding the differing planes into carry-save counters updates all distances of a block at
once, and a block is left as soon as every distance exceeds the radius. A group gives a forest of
links, never all its pairs. A group of more than ``BLOCK`` fingerprints is cut into blocks, and every pair
of blocks is a task's work of bounded size.

Edge cases: null, empty and blank texts have fingerprint 0, which links like any other; fewer than
three words make one shingle. Rows without a key join their group but never name it. Repeated rows
share a group. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import stash
from tideline.llm.components import components

SHINGLE, SEED = 3, 42
RADIUS = 3
#: Bit ranges of the five blocks, and members of a group that are compared at once.
CUTS = [0, 13, 26, 39, 52, 64]
BLOCK = 4096
#: A group up to this size is compared by shifting rows, many groups at once.
SMALL = 48


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word; the last word is padded with 0."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def count_bits(differences, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Lanes with at most ``radius`` differing bits, as a mask of words.

    ``differences`` yields, plane by plane, the word-wise differences. Counters are kept bit-sliced:
    counters[k] holds bit k of every lane's count, ``over`` the lanes beyond the counters. Stops once all are beyond.
    """
    width = radius.bit_length()
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    for seen, carry in enumerate(differences):
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if seen > 8 and seen % 4 == 0 and not (~over).any():
            return np.zeros(shape, np.uint64)
    within = ~over
    if radius != (1 << width) - 1:  # counts between radius and the counters' end
        at_most, equal = np.zeros(shape, np.uint64), ~np.zeros(shape, np.uint64)
        for k in reversed(range(width)):
            if radius >> k & 1:
                at_most |= equal & ~counters[k]
                equal &= counters[k]
            else:
                equal &= ~counters[k]
        within &= at_most | equal
    return within


def near_rows(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows side by side: which pairs are within the radius."""
    found = np.zeros(len(a), bool)
    for start in range(0, len(a), BLOCK * 16):
        part = slice(start, start + BLOCK * 16)
        sliced = planes(a[part] ^ b[part])
        mask = count_bits(iter(sliced), sliced.shape[1:], radius)
        found[part] = np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(a[part])].astype(bool)
    return found


def near_block(queries: np.ndarray, block: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Queries against a block of bit planes with n lanes: a boolean matrix."""
    bits = (queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    flip = np.where(bits.astype(bool), ~np.uint64(0), np.uint64(0))
    mask = count_bits((block[p] ^ flip[:, p, None] for p in range(64)), (len(queries), block.shape[1]), radius)
    return np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over the links a-b, by repeated lowering and jumping; label[i] <= i."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label != label[label]).any():
        label = label[label]
    return label


def forest(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near inside each group; rows of a group lie together."""
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
    sizes = np.diff(starts, append=n)
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, int(min(sizes.max(initial=0), SMALL))):
        at = np.flatnonzero((group[:-shift] == group[shift:]) & small[:-shift])
        at = at[label[at] != label[at + shift]]
        at = at[near_rows(fps[at], fps[at + shift])]
        label = merge(label, at, at + shift)
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = fps[s : s + size]
        block = planes(own)
        for q in range(0, size, 64):
            hits = near_block(own[q : q + 64], block, size)
            for i in np.flatnonzero(hits.sum(1) > 1):
                at = s + np.flatnonzero(hits[i])
                roots = np.unique(label[at])
                if len(roots) > 1:
                    members = s + np.flatnonzero(np.isin(label[s : s + size], roots))
                    label[members] = roots[0]
    child = np.flatnonzero(label != np.arange(n))
    return fps[child], fps[label[child]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (g, fp) rows; the last group of a batch waits for its end."""
    group, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(g, f):
        a, b = forest(g, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        group = np.concatenate([group, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if not len(group):
            continue
        done = int(np.searchsorted(group, group[-1]))
        if done:
            yield out(group[:done], fps[:done])
            group, fps = group[done:], fps[done:]
    if len(group):
        yield out(group, fps)


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """a and b: links that connect all distinct fingerprints within the radius of each other."""
    pairs = [(CUTS[i], CUTS[i + 1], CUTS[j], CUTS[j + 1]) for i, j in combinations(range(5), 2)]
    masks = [sum(((1 << hi - lo) - 1) << lo for lo, hi in (p[:2], p[2:])) for p in pairs]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(n), F.col(fp).bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])
    spread = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("g"))
    sizes = spread.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = spread.join(sizes, "g").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = met.withColumn("own", own).withColumn("other", other)
    work = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    tasks = split.select(F.when(F.col("blocks") == 1, F.col("g")).otherwise(work).alias("g"), "fp")
    return tasks.repartition("g").sortWithinPartitions("g").mapInArrow(_linked, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the group) and component_id, its smallest key, of every row."""
    each = stash(fingerprints(docs, key, text), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct), "a", "b").withColumnRenamed("node", "fp")
    named = stash(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "root", "component_id")
    return each.join(labels, "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest key of each group, with all its columns.

    Equal rows count once; a group whose rows have no key keeps one of them.
    """
    kept = groups(docs, key, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = kept.groupBy(F.col("root").alias("__root"), F.col("doc_id").alias("__key")).agg(F.min("fp").alias("__least"))
    # A key may name rows of several groups, so the fingerprint takes part in the join.
    marked = with_fingerprint(docs, text, "__fp")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__fp") == F.col("__least"))
    return marked.join(one, same).dropDuplicates(["__root", "__key"]).select(*docs.columns)


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """All columns and the fingerprint of the text."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(text)), np.uint64, batch.num_rows)
            columns = [*batch.columns, pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
