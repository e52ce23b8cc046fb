"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

A line's symbols are its words in lower case. Two lines are alike if they have the same words, or if one
word inserted, dropped or replaced turns one into the other and the longer has at least
``MIN_WORDS`` words. One edit is the bound whatever a line's length: two changed words in a long line keep it. A line is removed if an alike line stands earlier,
by document key, then line number; that one may itself go because of a still earlier one.

Equal lines collapse first. Each distinct line gives its deletion variants, one per word, as hashed
keys. Lines that share a variant with the same word left out are alike by replacement, so the earliest of
such a group is all that its members have to meet; a variant that equals a whole line is an insertion, and
meets that one line. So a key that holds any share of the lines gives one link a line, never pairs.
Links are verified on the words themselves. Lines give variants only if half of them, first or
last, also occurs in another line: of two alike lines, one half is always the same.

Everything is DataFrame functions. A line of w words costs w squared word copies for its variants.

Edge cases: null texts stay null; blank lines stay and are never compared; a text that loses all its
lines becomes empty. Rows equal in key and text count as one and end alike; null keys come first. Other
columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash, words

MIN_WORDS = 5


#: Rows up to which a table of line keys (under 100 bytes a row) is sent to every executor; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 250_000


def _hashes(ws: Column, first: str, second: str) -> list[Column]:
    """128 bits of a word list, as two longs."""
    return [F.xxhash64(ws).alias(first), F.xxhash64(F.lit(1), ws).alias(second)]


def _small(df: DataFrame, name: str) -> DataFrame:
    """The table, written; marked for broadcast if it has few rows."""
    kept = stash(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _part(n: Column) -> Column:
    """A length from 2, 3, 4, 6, 8, 12, ... that is half of n at most; neighbours mostly share it."""
    power = F.pow(F.lit(2), F.floor(F.log2(n / 2))).cast("int")
    return F.when(n < 4, 1).when(n * 2 >= power * 6, (power * 3 / 2).cast("int")).otherwise(power)


def _halves(ws: Column, n: Column) -> Column:
    """Keys of the first and the last part of a line; of two alike lines, one is the same.

    The part is at most half of the shorter line, so the changed word lies outside one of the two. A
    line also gives the parts of a line with a word less where these have another length.
    """

    def keys(size: Column) -> Column:
        first = F.xxhash64(F.lit("first"), size, F.slice(ws, F.lit(1), size))
        return F.array(first, F.xxhash64(F.lit("last"), size, F.slice(ws, n - size + 1, size)))

    sizes = F.when(n >= MIN_WORDS, F.array_distinct(F.array(_part(n), _part(n - 1)))).when(n == MIN_WORDS - 1, F.array(_part(n)))
    return F.flatten(F.transform(sizes, keys))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, h (hash of the text), i (line number) and ws (words) of every line that is not blank."""
    # The words are made inside the generator, so everything derived from them reads them and does not make them again.
    each = F.transform(F.split(F.col(text), "\n", -1), lambda line: words(F.lower(line)))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.posexplode(each).alias("i", "ws"))
    return rows.where(F.size("ws") > 0)


def _without(ws: Column, j: Column) -> Column:
    """The words without the one at position j, from 1."""
    return F.concat(F.slice(ws, F.lit(1), j - 1), F.slice(ws, j + 1, F.size(ws)))


def candidates(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """id, f1, f2, n and ws of the distinct lines that share a half with another; ids follow the first places."""
    keys = lines.where(F.col("halves").isNotNull()).select("f1", "f2", F.explode("halves").alias("half"))
    met = keys.groupBy("half").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a <> b").select("half")
    wanted = _small(keys.join(_small(met, "halves"), "half", "left_semi").distinct(), "wanted").select("f1", "f2")
    places = lines.join(wanted, ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.min(F.struct("k", "h", "i")).alias("at"))
    own = F.collect_list(F.struct("at.i", "f1", "f2")).alias("own")
    by_text = _small(places.groupBy(F.col("at.k").alias("pk"), F.col("at.h").alias("ph")).agg(own), "by-text")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    found = rows.join(by_text, F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph")))
    line = F.get(F.split("t", "\n", -1), F.col("o.i"))
    found = found.select("k", "h", "t", F.explode("own").alias("o")).select("k", "h", "o.*", words(F.lower(line)).alias("ws"))
    # Rows equal in key and text give a line twice.
    once = found.dropDuplicates(["f1", "f2"]).select(F.struct("k", "h", "i").alias("at"), "f1", "f2", F.size("ws").alias("n"), "ws")
    ordered = once.repartitionByRange("at").sortWithinPartitions("at")
    return stash(ordered.select(F.monotonically_increasing_id().alias("id"), "f1", "f2", "n", "ws"), "candidates")


def near_lines(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """f1 and f2 of the distinct lines for which an alike, not equal line stands earlier."""
    near = candidates(docs, lines, key, text)
    each = near.where(F.col("n") >= MIN_WORDS).select("id", "ws", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"))
    variants = stash(each.select("id", "j", *_hashes(_without(F.col("ws"), F.col("j")), "r1", "r2")), "variants")

    # The same word left out: alike by replacement, and the earliest of a key is met by all.
    replaced = ["r1", "r2", "j"]
    earliest = variants.groupBy(*replaced).agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    same = variants.join(_small(earliest, "earliest"), replaced).where("other < id").select("id", "j", "other")
    # A variant that is a whole line: the longer meets that line, the shorter the earliest of its longer ones.
    whole = _small(near.select(F.col("id").alias("short"), F.col("f1").alias("r1"), F.col("f2").alias("r2")), "whole")
    inserted = variants.join(whole, ["r1", "r2"]).select("id", "j", "short")
    longer = inserted.where("short < id").select("id", "j", F.col("short").alias("other"))
    least = inserted.where("id < short").groupBy("short").agg(F.min(F.struct("id", "j")).alias("e"))
    shorter = least.select(F.col("short").alias("id"), F.col("e.j").alias("j"), F.col("e.id").alias("other"))

    links = stash(same.union(longer).union(shorter), "links")
    own = near.select("id", "f1", "f2", "n", "ws")
    other = near.select(F.col("id").alias("other"), F.col("n").alias("on"), F.col("ws").alias("os"))
    verified = links.join(own, "id").join(other, "other")
    a = F.when(F.col("n") < F.col("on"), F.col("ws")).otherwise(_without(F.col("ws"), F.col("j")))
    b = F.when(F.col("on") < F.col("n"), F.col("os")).otherwise(_without(F.col("os"), F.col("j")))
    return verified.where(a == b).select("f1", "f2").distinct()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h and gone, the numbers of the lines to remove, of every text that loses some."""
    halves = _halves(F.col("ws"), F.size("ws")).alias("halves")
    lines = stash(lines_of(docs, key, text).select("k", "h", "i", *_hashes(F.col("ws"), "f1", "f2"), halves), "all-lines")
    near = _small(near_lines(docs, lines, key, text).withColumn("near", F.lit(True)), "near")
    repeated = lines.groupBy("f1", "f2").agg(F.min(F.struct("k", "h", "i")).alias("first"), F.count(F.lit(1)).alias("c"))
    marked = _small(repeated.join(near, ["f1", "f2"], "left").where("c > 1 or near"), "marked")
    gone = lines.join(marked, ["f1", "f2"]).where(F.col("near").isNotNull() | (F.struct("k", "h", "i") != F.col("first")))
    return gone.groupBy("k", "h").agg(F.collect_set("i").alias("gone"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their repeated lines taken out of the text, and two counts.

    Adds __lines and __removed, the lines a text had and lost; all columns of the input are kept.
    """
    gone = removed_lines(docs, key, text).select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("gone").alias("__gone"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(F.col(text)) == F.col("__h"))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    short = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    counts = {"__lines": F.coalesce(F.size(lines), F.lit(0)), "__removed": F.coalesce(F.size("__gone"), F.lit(0))}
    counts = {c: F.greatest(v, F.lit(0)) for c, v in counts.items()}
    joined = docs.join(gone, same, "left").withColumns(counts).withColumn(text, short)
    return joined.select(*docs.columns, "__lines", "__removed")
