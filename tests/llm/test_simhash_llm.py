import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import simhash
from tideline.llm.components import components

from .conftest import nasty_texts, prose


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(99))
    return " ".join(words)


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(2)
    rows = list(nasty_texts())
    for g in range(12):
        base = prose(rng, 120)
        rows += [(100 + 20 * g + i, edited(rng, base, rng.choice([0, 1, 1, 2, 3]))) for i in range(rng.choice([1, 3, 15]))]
    return rows


def test_groups_equal_brute_force(spark, near):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    got = {}
    for r in simhash.groups(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect():
        got.setdefault((r.doc_id, r.f), set()).add(r.component_id)
    fps = [plain_fingerprint(t) for _, t in near]
    label = plain_groups(fps)
    keys = {}
    for (k, _), g in zip(near, label):
        if k is not None:
            keys[g] = min(keys.get(g, k), k)
    want = {}
    for (k, _), f, g in zip(near, fps, label):
        want.setdefault((k, format(f, "016x")), set()).add(keys.get(g))
    assert got == want


@pytest.mark.parametrize("block,small", [(8, 4), (4096, 3), (8, 48)])
def test_large_groups_are_cut(spark, near, monkeypatch, block, small):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    want = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.groups(docs).collect())
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.groups(docs).collect()) == want


def test_bit_sliced_counts():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    for radius in range(8):
        assert (simhash.near_rows(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
        block = simhash.planes(b)
        assert (simhash.near_block(a[:20], block, 1000, radius) == (np.bitwise_count(a[:20, None] ^ b) <= radius)).all()


def test_one_of_each_group_stays(spark, near, nasty, nothing):
    docs = spark.createDataFrame(near, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1)})
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = simhash.groups(docs).toPandas()
    rows = kept.toPandas()
    assert len(rows) == found["root"].nunique()
    assert simhash.deduplicate(nasty).columns == nasty.columns
    assert simhash.deduplicate(nothing).count() == simhash.groups(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100))
    assert got[2000] == got[2001] == 2000 and len(got) == 201 + 100 + 2
