import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.llm import line_dedup
from tideline.llm.catalog import oracle_sql, queries
from verify import rows_of

from .conftest import SF, nasty_texts, prose


def words_of(line):
    return [w for w in "".join(" " if c in "\t\r\x0b\x0c" else c for c in line).lower().split(" ") if w]


def alike(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:j] + long[j + 1 :] == short for j in range(len(long)))


def plain(rows):
    """Kept text by key and text, for rows with unequal keys or texts."""
    unique = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [(r, i, words_of(line)) for r in unique for i, line in enumerate(r[1].split("\n"))]
    gone = set()
    for at, (r, i, ws) in enumerate(lines):
        if ws and any(o and alike(ws, o) for _, _, o in lines[:at]):
            gone.add((r, i))
    return {r: "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r, i) not in gone) for r in unique} | {
        r: None for r in rows if r[1] is None
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [prose(rng, n) for n in (1, 2, 4, 4, 5, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33)]
    out = [(k, t) for k, t in nasty_texts() if k not in (5, None, 6)] + [(None, "only\nline of no key at all here")]
    for d in range(40):
        text = []
        for _ in range(5):
            ws = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                j = rng.randrange(len(ws))
                edit = rng.choice(["drop", "put", "change"])
                ws = ws[:j] + ([] if edit == "drop" else ["zz"] if edit == "change" else ["zz", ws[j]]) + ws[j + 1 :] or ["x"]
            text.append(rng.choice([" ", ""]) + " ".join(ws).upper() if rng.random() < 0.2 else " ".join(ws))
        out.append((100 + d, "\n".join(text)))
    return out


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_equals_brute_force(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(rows + rows[-2:], "doc_id long, text string").withColumn("n", F.lit(1)).repartition(4)
    got = line_dedup.deduplicate(docs)
    assert got.columns == [*docs.columns, "__lines", "__removed"]
    want = plain(rows)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(str((r[0], want[r])) for r in rows + rows[-2:])


def test_nasty_rows(spark, nasty, nothing):
    got = line_dedup.deduplicate(nasty).toPandas()
    assert len(got) == len(nasty_texts())
    assert got[got["doc_id"] == 1]["text"].isna().all() and (got[got["doc_id"] == 3]["__removed"] == 0).all()
    assert line_dedup.deduplicate(nothing).count() == 0


def test_plan_is_native(spark):
    df = queries()["op5_line_dedup"](spark, SF)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(oracle_sql()["op5_line_dedup"])
    cols = [c[0] for c in cur.description]
    df = queries()["op5_line_dedup"](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
