import random
import re
from collections import Counter

import duckdb
import pytest

from tideline.llm import quality_rules as Q
from tideline.llm.catalog import oracle_sql, queries
from verify import rows_of

from .conftest import SF, nasty_texts, prose

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(text):
    text = text or ""
    ws = [w for w in re.split(f"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + j for i, g in enumerate(grams) if g in often for j in range(3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(3)
    few = [" ".join(rng.choice("ab c d".split()) for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 60, 200)]
    a = prose(rng, 30, 5)
    return [t for _, t in nasty_texts()] + few + [a + "\n" + a, a.upper(), "x x x x", "a b c a b c", "#$ <b>|\x0b%\x85   x...\n • y…", "\x00\x00 a"]


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got}
    assert base == {i: plain(t) for i, t in rows}
    assert all(r.kept == (not r.base_failed and not r.failed) for r in got)


def test_hashes_decide_nothing(spark, monkeypatch):
    """With one hash for all windows, each is still compared by its words."""
    from pyspark.sql import functions as F

    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.n_repeat_words) for r in Q.judge(docs).collect())
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert sorted((r.doc_id, r.n_repeat_words) for r in Q.judge(docs).collect()) == want


def test_rules_are_a_table(spark):
    rng = random.Random(1)
    good = " ".join(f"the {w}" for w in dict.fromkeys(prose(rng, 400).split())) + " " + prose(rng, 60)
    words = [f"word{i}" for i in range(60)]
    docs = [
        (0, good), (1, " ".join(words)), (2, good.upper()), (3, " ".join(f"the {w}$$" for w in words)),
        (4, "\n".join(f"- the {w}" for w in words)), (5, "\n".join(f"the {w} ..." for w in words)), (6, "the " * 5 + "x" * 3000 + " y" * 45),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    failed = {r.doc_id: r.failed for r in Q.judge(docs).collect()}
    assert failed[0] == [] and failed[1] == ["stop words"] and "words in capitals" in failed[2] and "symbols" in failed[3]
    assert "bullet lines" in failed[4] and "cut lines" in failed[5] and "mean word length" in failed[6]
    own = [Q.Rule("short", "n_words", most=59)]
    assert {r.doc_id: r.failed for r in Q.judge(docs, own).collect()}[1] == ["short"]
    assert all(r.failed == [] for r in Q.judge(docs, []).collect())


def test_nasty_rows(spark, nasty, nothing):
    got = Q.judge(nasty).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in nasty_texts())
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 3, 4, 11, 12))
    assert Q.judge(nothing).count() == 0


def test_long_text(spark):
    text = prose(random.Random(2), 300_000)
    row = Q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == plain(text)


def test_plan_is_one_native_projection(spark):
    plan = queries()["op12_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(oracle_sql()["op12_quality_rules"])
    cols = [c[0] for c in cur.description]
    df = queries()["op12_quality_rules"](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
