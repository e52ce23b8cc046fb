import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate
from tideline.llm.catalog import oracle_sql, queries
from verify import rows_of

from .conftest import SF, nasty_texts, prose


def grams(ws, m):
    return Counter(tuple(ws[i : i + m]) for i in range(max(len(ws) - m, 0) + 1))


def best(doc, item):
    """Largest similarity over all windows of the item's size."""
    ws = "".join(c.lower() if c.isalnum() else " " for c in doc or "").split()
    own = "".join(c.lower() if c.isalnum() else " " for c in item or "").split()
    if not ws or not own:
        return 0
    m, b, found = min(5, len(own)), None, 0
    b = grams(own, m)
    for s in range(max(len(ws) - len(own), 0) + 1):
        a = grams(ws[s : s + len(own)], m)
        found = max(found, sum((a & b).values()) / sum((a | b).values()))
    return found


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    items = [prose(rng, n) for n in (3, 4, 5, 6, 12, 20, 30, 45, 80)] + [None, "", "?!"]
    docs = [(k, t) for k, t in nasty_texts() if k not in (5, 6)]
    for d in range(60):
        ws = rng.choice(items[:9]).upper().split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):  # changed words only: windows stay in step
            ws[rng.choice([0, len(ws) - 1, rng.randrange(len(ws))])] = "zz"
        around = [prose(rng, rng.choice([1, 20, 60])) for _ in range(2)]
        docs.append((100 + d, rng.choice(["{0} {1} {2}", "{1}", "{0}\n{1}", "{1} {2} {1}"]).format(around[0], " ".join(ws), around[1])))
    return docs, [(i, t) for i, t in enumerate(items)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_equals_brute_force(spark, tables, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    docs, items = tables
    left = spark.createDataFrame(docs + docs[-3:], "doc_id long, text string").withColumn("ws", F.lit(0)).repartition(3)
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string").withColumn("n", F.lit(0))
    got = {(r.k, r.item_id): r.similarity for r in decontaminate.matches(left, bench).collect()}
    want = {(k, i): best(t, x) for k, t in docs for i, x in items}
    want = {p: s for p, s in want.items() if s >= 0.8}
    assert got == pytest.approx(want)
    bad = {k for k, _ in want}
    kept = decontaminate.clean(left, bench)
    assert kept.columns == left.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in docs + docs[-3:] if k not in bad)


def test_windows_out_of_step(spark):
    """Words put in, left out and moved: no anchor need have its own place in the best window."""
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate((60, 80, 100, 100))]
    docs = []
    for i, text in items:
        ws = text.split(" ")
        half = len(ws) // 2
        for j, changed in enumerate((ws[half:] + ws[:half], ws[:half] + ["zz"] + ws[half:], ws[:half] + ws[half + 1 :], ws[-20:] + ws[:-20])):
            docs.append((10 * i + j, " ".join([prose(rng, 30), *changed, prose(rng, 30)])))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.k, r.item_id): r.similarity for r in decontaminate.matches(left, spark.createDataFrame(items, "item_id int, text string")).collect()}
    want = {(k, i): best(t, x) for k, t in docs for i, x in items}
    assert got == pytest.approx({p: s for p, s in want.items() if s >= 0.8}) and len(got) > 12


def test_empty_sides(spark, tables, nothing):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    bench = spark.createDataFrame(tables[1], "item_id long, text string")
    assert decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(tables[0])


def test_plan_is_native(spark):
    plan = queries()["op9_decontaminate"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle_sql()["op9_decontaminate"])
    cols = [c[0] for c in cur.description]
    df = queries()["op9_decontaminate"](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
