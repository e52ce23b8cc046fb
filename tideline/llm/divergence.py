"""How far the term shares of the sources of a language lie apart, with late strings.

What is counted and shuffled is fixed in width: a term travels as a 64-bit digest. A task counts the terms of its texts per
language and source, ``AT_ONCE`` distinct ones at a time, and only digests with their counts are shuffled. Digests in
enough documents are kept. Only for these is a string looked for, by tasks that know the kept digests (beyond ``BROADCAST_ROWS``
by a join): the (digest, term) pairs of the texts give each digest its least and its greatest string. Where the two differ, several terms share the digest;
their texts are counted again by the terms themselves, so a collision costs time and changes nothing. The other
strings come back only for rows of the result, and for those they tie with.

Shares are whole billionths, p = 1 + floor(10^9 (count + 1) / (N + V)), with N occurrences of the language's V kept
terms in the group. The divergence of group p from q in a term is floor((p - q)^2 / q).

Pairs of sources: only terms that two sources both have make the two meet. A term that one of them lacks has a share
that depends on the sources alone, so its part of the sum comes from the histogram of counts of the other one. Sources
meet in blocks of ``BLOCK`` a term, so a word that every source has is spread over tasks, and sums are taken before they
are shuffled. The result itself has a row per ordered pair of sources of a language.

Edge cases: null text, language and source count as ''. A group without terms has its rows in part pair, with all shares
1 + floor(10^9 / V); V = 0 gives 0 everywhere. Ties are ordered by the item in UTF-8. Repeated rows are documents of their own. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stash

#: A term in UTF-8: all of ASCII but its letters separates, every other byte belongs to a term. A to Z become small, what separates a space.
_SPACED = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
BILLION = 1_000_000_000
#: Distinct terms that a task counts before it hands them on.
AT_ONCE = 500_000
#: Rows of digests (8 bytes each) that the driver gathers and that are sent to every executor; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sources of one term that meet the others of the term in one task.
BLOCK = 256


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(_SPACED).split()


def digests(found: Iterable[bytes], bits: int) -> np.ndarray:
    """XXH64 of each term as a signed long, or its first bits."""
    whole = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64)
    return (whole >> np.uint64(64 - bits) if bits else whole * np.uint64(0)).astype(np.int64)


#: A term's tally is one number: its documents in the high bits, its occurrences in these low ones.
_LOW = 40


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], dict[bytes, int]]]:
    """Tallies per (lang, source) and term of rows (text in UTF-8, lang, source), a portion at a time."""
    found: dict[tuple[str, str], dict[bytes, int]] = {}
    held, one = 0, 1 << _LOW
    for batch in batches:
        for text, *group in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")]):
            mine = found.setdefault(tuple(group), {})
            held -= len(mine)
            for term, c in Counter(terms(text)).items():
                mine[term] = mine.get(term, 0) + c + one
            held += len(mine)
            if held > AT_ONCE:
                yield found
                found, held = {}, 0
    yield found


def counted(docs: DataFrame, bits: int, by_string: bool) -> DataFrame:
    """lang, source, digest, n, docs; with the term itself as ``twin`` if asked for."""
    names = ["lang", "source", "digest", *(["twin"] if by_string else []), "n", "docs"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in tally(batches):
            for (lang, source), mine in portion.items():
                both = np.fromiter(mine.values(), dtype=np.int64)
                group = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(both), dtype=np.int32))) for v in (lang, source)]
                text = [pa.array([t.decode() for t in mine], pa.string())] if by_string else []
                columns = [*group, pa.array(digests(mine, bits)), *text, pa.array(both & ((1 << _LOW) - 1)), pa.array(both >> _LOW)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"lang string, source string, digest long, {'twin string, ' if by_string else ''}n long, docs long"
    return _texts(docs).mapInArrow(rows, schema).groupBy(*names[:-2]).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def strings(docs: DataFrame, bits: int, wanted: Broadcast | None = None) -> DataFrame:
    """digest and item of the terms of the texts, each once for many texts; only of ``wanted`` digests (sorted) if given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new: set[bytes] = set()
            for text in batch.column("text").to_pylist():
                new.update(terms(text))
            new -= seen
            own = digests(new, bits)
            if wanted is not None:
                asked = among(own, wanted.value)
                own, names = own[asked], list(compress(new, asked))
            else:
                names = list(new)
            seen = set(names) if len(seen) + len(names) > AT_ONCE else seen.union(names)
            columns = [pa.array(own), pa.array([t.decode() for t in names], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "item"])

    return _texts(docs).select("text").mapInArrow(rows, "digest long, item string")


def among(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    at = np.searchsorted(kept, values)
    found = at < len(kept)
    found[found] = kept[at[found]] == values[found]
    return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.encode("text", "UTF-8").alias("text"), "lang", "source")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), in longs while these hold the product."""
    unit, whole = count + 1, total + kept
    small = F.call_function("div", unit * BILLION, whole)
    wide = F.call_function("div", unit.cast("decimal(28,0)") * F.lit(BILLION).cast("decimal(10,0)"), whole.cast("decimal(28,0)"))
    return 1 + F.when(unit <= BILLION, small).otherwise(wide)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def few(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The table, written; marked for broadcast if it was counted to be small."""
    kept = stash(df, name)
    return F.broadcast(kept) if kept.count() <= (BROADCAST_ROWS if most is None else most) else kept


def term_counts(docs: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, twin, n) and names (digest, twin, item) of the terms kept in their language.

    ``twin`` is null, or the term itself where several terms have one digest.
    """
    by_group = stash(counted(docs, bits, by_string=False), "term-counts")
    often = by_group.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    often = stash(often.select("lang", "digest"), "kept-digests")

    wanted = stash(often.select("digest").distinct(), "wanted-digests")
    if wanted.count() <= BROADCAST_ROWS:
        kept = np.sort(wanted.toArrow().column("digest").to_numpy())
        pairs = strings(docs, bits, docs.sparkSession.sparkContext.broadcast(kept))
    else:
        pairs = strings(docs, bits).join(wanted, "digest", "left_semi")
    ends = stash(pairs.groupBy("digest").agg(F.min("item").alias("item"), F.max("item").alias("last")), "strings")
    shared = ends.where(F.col("item") != F.col("last"))
    alone = ends.where(F.col("item") == F.col("last"))
    counts = by_group.join(often, ["lang", "digest"]).select("lang", "source", "digest", F.lit(None).cast("string").alias("twin"), "n")
    names = alone.select("digest", F.lit(None).cast("string").alias("twin"), "item")
    if shared.isEmpty():
        return counts, names

    # Terms whose digest is not theirs alone are counted by themselves.
    clash = few(shared.select("digest"), "shared-digests")
    split = stash(counted(docs, bits, by_string=True).join(clash, "digest", "left_semi"), "split-counts")
    enough = split.groupBy("lang", "digest", "twin").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    again = split.join(enough.select("lang", "digest", "twin"), ["lang", "digest", "twin"])
    counts = counts.join(clash, "digest", "left_anti").select("lang", "source", "digest", "twin", "n")
    counts = counts.unionByName(again.select(*counts.columns))
    return counts, names.unionByName(split.select("digest", "twin", F.col("twin").alias("item")).distinct())


def pair_part(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one, over all kept terms.

    ``groups`` has (lang, source, total, kept, p0): p0 is the share of a term that the source lacks.
    """
    here = counts.select("lang", "source", "digest", "twin", "n", "p", "p0")
    width = here.groupBy("lang", "digest", "twin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    key = (F.col("a.lang") == F.col("w.lang")) & (F.col("a.digest") == F.col("w.digest")) & F.col("a.twin").eqNullSafe(F.col("w.twin"))
    placed = here.alias("a").join(width.alias("w"), key).select("a.*", "blocks")
    left = placed.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    right = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = left.alias("a").join(
        right.alias("b"),
        (F.col("a.lang") == F.col("b.lang")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.block") == F.col("b.block"))
        & F.col("a.twin").eqNullSafe(F.col("b.twin")) & (F.col("a.source") < F.col("b.source")),
    )

    def beyond(x: str, y: str) -> Column:
        """What a common term adds to the sums that take it as lacking in one of the two."""
        p, q, p0, q0 = F.col(f"{x}.p"), F.col(f"{y}.p"), F.col(f"{x}.p0"), F.col(f"{y}.p0")
        return apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)

    both = met.groupBy("a.lang", F.col("a.source").alias("s"), F.col("b.source").alias("t")).agg(
        F.sum(beyond("a", "b")).alias("st"), F.sum(beyond("b", "a")).alias("ts")
    )
    both = stash(both, "source-pairs")
    common = both.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("common")).unionByName(
        both.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("common"))
    )

    # Terms that only one of the two has: as many sums as it has different counts.
    steps = counts.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = steps.join(other, "lang").where(F.col("source") != F.col("item"))
    ours, theirs = apart(F.col("p"), F.col("q0")), apart(F.col("q0"), F.col("p"))
    lacking = [apart(F.col("p0"), F.col("q0")), apart(F.col("q0"), F.col("p0"))]
    sums = alone.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (ours - lacking[0])).alias("ours"), F.sum(F.col("terms") * (theirs - lacking[1])).alias("theirs")
    )
    sums = stash(sums, "lacking")
    mine = sums.select("lang", "source", "item", "ours")
    yours = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "theirs")
    ordered = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    where = ["lang", "source", "item"]
    joined = ordered.join(mine, where, "left").join(yours, where, "left").join(common, where, "left")
    zero = F.lit(0).cast("long")
    value = F.col("kept") * apart(F.col("p0"), F.col("q0"))
    for name in ("ours", "theirs", "common"):
        value = value + F.coalesce(name, zero)
    return joined.select(*where, F.when(F.col("kept") > 0, value).otherwise(zero).alias("value"))


def term_part(counts: DataFrame, names: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value): each group's terms of the highest divergence from the language, ``ranks`` at most, ties cut by item."""
    rows = counts.where(F.col("p") > F.col("q")).withColumn("value", apart(F.col("p"), F.col("q")))
    rows = rows.select("lang", "source", "digest", "twin", "value")
    group = Window.partitionBy("lang", "source")
    # The value at the last rank is found on digests; rows that reach it, ties included, get their strings.
    top = rows.withColumn("r", F.row_number().over(group.orderBy(F.desc("value"), "digest"))).where(F.col("r") <= ranks)
    bar = top.groupBy("lang", "source").agg(F.min("value").alias("bar"))
    reach = stash(rows.join(bar, ["lang", "source"]).where(F.col("value") >= F.col("bar")).drop("bar"), "top-terms")
    same = (F.col("r.digest") == F.col("s.digest")) & F.col("r.twin").eqNullSafe(F.col("s.twin"))
    named = reach.alias("r").join(names.alias("s"), same).select("lang", "source", "item", "value")
    placed = named.withColumn("r", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return placed.where(F.col("r") <= ranks).drop("r")


def audit(
    docs: DataFrame, least_docs: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64
) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank. ``bits`` is the width of a digest, for tests."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts, names = term_counts(docs, least_docs, bits)
    counts = stash(counts, "kept-counts")
    names = stash(names, "names")
    terms_of = counts.groupBy("lang", "digest", "twin").agg(F.sum("n").alias("whole_n"))
    # One row a group, and one a language.
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = terms_of.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole_n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"])
    p0 = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = few(groups.withColumn("p0", p0), "groups", most=100_000)
    same = (F.col("c.lang") == F.col("t.lang")) & (F.col("c.digest") == F.col("t.digest")) & F.col("c.twin").eqNullSafe(F.col("t.twin"))
    rows = counts.alias("c").join(terms_of.alias("t"), same).select("c.*", "whole_n").join(groups, ["lang", "source"])
    rows = rows.select(
        "lang", "source", "digest", "twin", "n", "p0",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("whole_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    rows = stash(rows, "shares")
    pairs = pair_part(rows, groups).withColumn("part", F.lit("pair"))
    best = term_part(rows, names, ranks).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    found = pairs.unionByName(best).withColumn("rank", F.row_number().over(order))
    return found.select("lang", "source", "part", "item", "value", "rank")
