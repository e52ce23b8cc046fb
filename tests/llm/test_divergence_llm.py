import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import divergence as D
from tideline.llm.catalog import oracle_sql, queries
from verify import rows_of

from .conftest import SF, nasty_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, least=3, ranks=200):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source, ts = lang or "", source or "", terms(text)
        counts[lang, source].update(ts)
        seen[lang].update(set(ts))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in seen.items()}
    langs = defaultdict(Counter)
    for (lang, _), c in counts.items():
        langs[lang].update(c)

    def shares(c, ks):
        total = sum(c[t] for t in ks)
        return {t: 1 + 10**9 * (c[t] + 1) // (total + len(ks)) for t in ks}

    p = {g: shares(c, kept[g[0]]) for g, c in counts.items()}
    q = {lang: shares(c, kept[lang]) for lang, c in langs.items()}
    out = []
    for g in p:
        found = {"pair": [], "term": []}
        for o in p:
            if o[0] == g[0] and o != g:
                found["pair"].append((-sum((p[g][t] - b) ** 2 // b for t, b in p[o].items()), o[1].encode()))
        for t, b in q[g[0]].items():
            if counts[g][t] and p[g][t] > b:
                found["term"].append((-((p[g][t] - b) ** 2 // b), t.encode()))
        for part, rows in found.items():
            for rank, (v, item) in enumerate(sorted(rows), 1):
                if part == "pair" or rank <= ranks:
                    out.append((*g, part, item.decode(), -v, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocabulary = [a + b for a in "ka Lo é mi ß ne".split() for b in "ran ser Ü dol 漢 x".split()]
    out = [(t, "en", None) for _, t in nasty_texts() if t is None or len(t) < 3000]
    for i in range(160):
        lang = rng.choice(["en", "en", "fr", None])
        source = rng.choice(["hot", "hot", "b", "a", "é", None]) if lang else "s"
        few = rng.sample(vocabulary, rng.choice([4, 20]))
        out.append((rng.choice([" ", "\n", "-1 "]).join(rng.choice(few) for _ in range(rng.choice([0, 1, 7, 80]))), lang, source))
    return out + [("", "en", "blank"), (None, "en", "none"), ("alone words", "xx", "p"), ("other", "xx", "q"), (None, None, None)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_terms_of_every_character():
    """All of ASCII, white space beyond it, letters that only Unicode makes small, and an empty text."""
    for text in ("", "".join(map(chr, range(256))) + "AZ[`az{\x7f", "a\x85b\xa0C\u2003D\u3000É\u0130 \x1c\x1fx\x0by", "x" + "".join(f"{chr(c)}A" for c in range(0x3000))):
        assert [t.decode() for t in D.terms(text.encode())] == terms(text)


def test_strings_are_looked_up_for_wanted_digests_only(spark, docs):
    df = frame(spark, docs).na.fill("")
    every = {(r.digest, r.item) for r in D.strings(df, 64).collect()}
    some = sorted(d for d, _ in every)[::3]
    got = {(r.digest, r.item) for r in D.strings(df, 64, spark.sparkContext.broadcast(np.array(some))).collect()}
    assert got == {(d, t) for d, t in every if d in set(some)} and got
    assert D.strings(df, 64, spark.sparkContext.broadcast(np.array([], np.int64))).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_equals_brute_force(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    clash = {c: F.lit(1) for c in ("digest", "twin", "n", "p", "q", "p0", "item", "value", "rank", "part", "kept", "total", "blocks", "docs")}
    assert result(D.audit(frame(spark, docs).withColumns(clash))) == plain(docs)


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_shared_digests_change_nothing(spark, docs, bits):
    assert result(D.audit(frame(spark, docs), bits=bits)) == plain(docs)


def test_portions_change_nothing(spark, docs, monkeypatch):
    batches = D._texts(frame(spark, docs).na.fill("")).toArrow().to_batches(max_chunksize=9)

    def whole():
        sums = Counter()
        portions = list(D.tally(iter(batches)))
        for portion in portions:
            for group, terms_ in portion.items():
                for t, n in terms_.items():
                    sums[group, t] += n
        return sums, len(portions)

    want, _ = whole()
    monkeypatch.setattr(D, "AT_ONCE", 12)
    got, portions = whole()
    assert got == want and portions > 5


def test_blocks_and_ranks(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 2)
    assert result(D.audit(frame(spark, docs), least_docs=2, ranks=4)) == plain(docs, 2, 4)


def test_shares_stay_exact_beyond_longs(spark):
    rows = [(0, 0, 7), (3, 10, 4), (10**9, 10**12, 5), (10**12, 10**13 + 7, 10**6), (8, 8, 1)]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("*", D.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in df.collect())


def test_empty(spark, nothing):
    got = D.audit(nothing.withColumn("source", F.lit("x")))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shuffles_of_counts_hold_no_strings(spark, docs):
    """What the counts of a text are shuffled by is a digest, never a term."""
    assert dict(D.counted(frame(spark, docs).na.fill(""), 64, False).dtypes) == {
        "lang": "string", "source": "string", "digest": "bigint", "n": "bigint", "docs": "bigint"
    }


@pytest.mark.parametrize("sf", [SF])
def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(oracle_sql()["op13_divergence"])
    cols = [c[0] for c in cur.description]
    df = queries()["op13_divergence"](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
