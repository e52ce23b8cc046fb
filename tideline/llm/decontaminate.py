"""Documents that hold a benchmark item, by SimHash of item-sized windows.

Words are runs of letters and digits in lower case; shingles are five words (an item of fewer words is
one shingle). Two texts are alike if the weighted Jaccard similarity of their shingles, weights being
counts, is at least 0.8. An item can then lose at most a fifth of its shingles, so one of any
larger set of them, its anchors, stands in the document. Every window as long as the item that holds
enough of its anchors, at whatever places, is laid: a window of full length that is alike lacks at most a ninth of the
item's shingles, so no window that is alike is left out, also where words are put in, left out or moved.
Windows and items get SimHash fingerprints over their weighted shingles; a fingerprint is cut into four blocks, and the index holds each item under every
value within a quarter of the radius of its blocks, which finds all fingerprints within the radius.
Candidates are verified by the exact similarity.

Everything is DataFrame functions. Equal windows are fingerprinted, searched and verified once, so a
passage that many documents share costs one row each, not a comparison each. The radius of 15 bits
keeps a window of similarity 0.8 with a chance of 97 %, of 0.9 with 99.9 %; larger costs more index rows.

Edge cases: null and empty texts match nothing, nor do items without words. A document shorter than the
item is its own window. Rows equal in key and text count as one and are judged alike. Other columns are
ignored or, in the filter, kept. An empty table on either side gives no matches. Of windows that are equally
alike, one with an anchor in its own place comes first, then the earliest.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
#: Anchor rows up to which their table (40 bytes a row) is sent to every executor.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, size: Column) -> Column:
    """Shingles of ``size`` words, repeats included; the whole list if it is shorter."""
    last = F.greatest(F.size(ws) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(ws, i, size), " "))


def fingerprint(grams: str) -> Column:
    """SimHash of a column of shingles: a bit is set if it is in more than half of their hashes."""
    return F.expr(
        f"""transform(array(transform({grams}, g -> xxhash64(g))), hs -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(
            2 * aggregate(hs, 0, (c, x) -> c + CAST(shiftright(x, b) & 1L AS INT)) > size(hs), shiftleft(1L, b), 0L)))[0]"""
    )


def block(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def flips() -> list[int]:
    """Values that change at most a quarter of the radius in bits of a block."""
    most = RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)]


def prepared(bench: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, n (words), m (words of a shingle), grams and fp of every item with words."""
    items = bench.select(F.col(key).alias("item_id"), tokens(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("n", F.size("ws")).withColumn("m", F.least("n", F.lit(SHINGLE)))
    grams = items.select("item_id", "n", "m", shingles(F.col("ws"), F.col("m")).alias("grams")).distinct()
    return stash(grams.withColumn("fp", fingerprint("grams")), "items")


def anchors(items: DataFrame) -> DataFrame:
    """a (hash), c (item text), m, n, os (places) and need, for enough distinct shingles of each item that one survives in what is alike.

    ``need`` is how many of its item's hashes a window of n words holds at least if it is alike: both have the same
    number of shingles then, and 0.8 of similarity is 8/9 of them in common.
    """
    count = F.floor(F.round((1 - SIMILARITY) * F.size("grams"), 6)).cast("int") + 1
    ordered = F.array_sort(F.transform(F.array_distinct("grams"), lambda g: F.struct(F.md5(g).alias("d"), g.alias("g"))))
    texts = items.select("n", "m", "grams").distinct().withColumn("c", F.md5(F.array_join("grams", "\n")))
    chosen = texts.withColumn("chosen", F.slice(F.transform(ordered, lambda x: x["g"]), F.lit(1), count))
    lost = F.floor(F.round((1 - SIMILARITY) / (1 + SIMILARITY) * F.size("grams"), 6)).cast("int")
    held = F.size(F.array_distinct(F.transform("chosen", lambda g: F.xxhash64(g))))
    chosen = chosen.withColumn("need", F.greatest(held - lost, F.lit(1)))
    placed = chosen.select("c", "n", "m", "need", "chosen", F.posexplode("grams").alias("o", "gram")).where(
        F.array_contains("chosen", F.col("gram"))
    )
    return placed.groupBy(F.xxhash64("gram").alias("a"), "c", "m", "n", "need").agg(F.collect_set("o").alias("os"))


def _hashed(ws: str, m: int) -> Column:
    """p (place from 0) and a (hash) of every shingle of m words; none if there are fewer."""
    places = F.when(F.size(ws) >= m, F.sequence(F.lit(0), F.size(ws) - m))
    return F.transform(places, lambda p: F.struct(p.alias("p"), F.xxhash64(F.array_join(F.slice(ws, p + 1, m), " ")).alias("a")))


def windows(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """k, h, s (first word), n, m, step (an anchor has its own place) and ws (words) of every window with enough anchors of an item."""
    points = stash(anchors(items), "anchors")
    sizes = [r[0] for r in points.select("m").distinct().collect()]  # at most SHINGLE values
    if points.count() <= BROADCAST_ROWS:
        points = F.broadcast(points)
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    rows = texts.select("k", "h", tokens(F.col("t")).alias("ws"))
    hits = None
    for m in sizes or [SHINGLE]:
        found = rows.select("k", "h", F.size("ws").alias("length"), F.inline(_hashed("ws", m)))
        hit = found.join(points.where(F.col("m") == m), "a")
        hits = hit if hits is None else hits.union(hit)
    # The windows that hold the shingle at p; a text shorter than the item is its own window.
    last = F.greatest(F.col("length") - F.col("n"), F.lit(0))
    first = F.greatest(F.col("p") - (F.col("n") - F.col("m")), F.lit(0))
    hits = hits.withColumn("need", F.when(F.col("length") < F.col("n"), 1).otherwise(F.col("need")))
    hits = hits.withColumn("steps", F.transform("os", lambda o: F.greatest(F.least(F.col("p") - o, last), F.lit(0))))
    hits = hits.withColumn("s", F.explode(F.sequence(first, F.least(F.col("p"), last))))
    held = hits.groupBy("k", "h", "s", "n", "m", "c", "need", "a").agg(F.max(F.array_contains("steps", F.col("s"))).alias("step"))
    held = held.groupBy("k", "h", "s", "n", "m", "c", "need").agg(F.count(F.lit(1)).alias("anchors"), F.max("step").alias("step"))
    starts = held.where(F.col("anchors") >= F.col("need")).groupBy("k", "h", "s", "n", "m").agg(F.max("step").alias("step"))
    by_text = starts.groupBy("k", "h").agg(F.collect_list(F.struct("s", "n", "m", "step")).alias("own"))
    by_text = by_text.select(F.col("k").alias("pk"), F.col("h").alias("ph"), "own")
    same = F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph"))
    cut = F.transform("own", lambda o: F.struct(o["s"], o["n"], o["m"], o["step"], F.slice("ws", o["s"] + 1, o["n"]).alias("ws")))
    # Texts are shuffled as they are and cut into words again: fewer bytes than arrays of words.
    return texts.join(by_text, same).select("k", "h", "own", tokens(F.col("t")).alias("ws")).select("k", "h", F.inline(cut))


def matches(
    docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """k, h, item_id, similarity and first_word of the best window for every document and item that are alike."""
    items = prepared(bench, item_key, item_text)
    laid = stash(
        windows(docs, items, key, text)
        .withColumn("grams", shingles(F.col("ws"), F.col("m")))
        .select("k", "h", "s", "n", "step", "grams", F.xxhash64("grams").alias("w1"), F.xxhash64(F.lit(1), "grams").alias("w2")),
        "windows",
    )
    distinct = stash(
        laid.dropDuplicates(["w1", "w2", "n"]).select("w1", "w2", "n", "grams").withColumn("fp", fingerprint("grams")),
        "distinct-windows",
    )
    masks = F.array(*[F.lit(x).cast("long") for x in flips()])
    index = items.select(
        "item_id", "n", F.col("fp").alias("item_fp"), F.posexplode(F.array(*[block(F.col("fp"), b) for b in range(BLOCKS)])).alias("b", "v")
    ).select("item_id", "n", "item_fp", "b", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("v")))).alias("v"))
    probes = distinct.select("w1", "w2", "n", "fp", F.posexplode(F.array(*[block(F.col("fp"), b) for b in range(BLOCKS)])).alias("b", "v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    # Spark's estimate does not see what explode adds, so it would broadcast an index of any size.
    candidates = probes.join(index.hint("merge"), ["n", "b", "v"]).where(near).select("w1", "w2", "n", "item_id").distinct()
    candidates = stash(candidates, "candidates")

    own = distinct.join(candidates, ["w1", "w2", "n"], "left_semi").select("w1", "w2", "n", F.size("grams").alias("wn"), F.explode("grams").alias("g"))
    own = own.groupBy("w1", "w2", "n", "wn", "g").agg(F.count(F.lit(1)).alias("wc"))
    theirs = items.select("item_id", "n", F.size("grams").alias("tn"), F.explode("grams").alias("g"))
    theirs = theirs.groupBy("item_id", "n", "tn", "g").agg(F.count(F.lit(1)).alias("tc"))
    shared = candidates.join(own, ["w1", "w2", "n"]).join(theirs, ["item_id", "n", "g"])
    shared = shared.groupBy("w1", "w2", "n", "item_id", "wn", "tn").agg(F.sum(F.least("wc", "tc")).alias("both"))
    similarity = F.col("both") / (F.col("wn") + F.col("tn") - F.col("both"))
    alike = shared.select("w1", "w2", "n", "item_id", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    found = laid.select("k", "h", "s", "step", "w1", "w2", "n").join(alike, ["w1", "w2", "n"])
    best = F.max(F.struct("similarity", "step", (-F.col("s")).alias("back"))).alias("best")
    return found.groupBy("k", "h", "item_id").agg(best).select(
        "k", "h", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word")
    )


def clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    found = matches(docs, bench, key, text).select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(F.col(text)) == F.col("__h"))
    return docs.join(found, same, "left_anti")
