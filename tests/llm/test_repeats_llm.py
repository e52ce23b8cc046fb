import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tideline.llm import repeats

from .conftest import nasty_texts, prose


def plain(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (40, 60, 90)]
    out = nasty_texts()
    for d in range(50):
        parts = [prose(rng, rng.randrange(5, 60)) for _ in range(2)]
        parts.insert(rng.randrange(3), rng.choice(shared)[rng.randrange(40) :])
        if rng.random() < 0.3:
            parts.append(rng.choice(shared)[: rng.randrange(150, 400)])
        out.append((100 + d, "é".join(parts)))
    out += [(300, "ab" * 400), (301, "ab" * 130), (302, "x" * 199), (303, "y" * 200), (304, "é" * 300), (305, "z" * 5000)]
    return out


@pytest.mark.parametrize("pieces,bits,remembered", [(4096, 1 << 29, 400_000), (3, 1 << 29, 400_000), (4096, 1 << 15, 5), (3, 1 << 15, 5)])
def test_equals_brute_force(spark, texts, monkeypatch, pieces, bits, remembered):
    """Crowded names, a crowded bit map and tasks that forget kinds change no result."""
    monkeypatch.setattr(repeats, "PIECES", pieces)
    monkeypatch.setattr(repeats, "MOST_BITS", bits)
    monkeypatch.setattr(repeats, "REMEMBERED", remembered)
    docs = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, name int").repartition(4)
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.remove(docs).collect())
    assert got == sorted(str((k, *w)) for (k, _), w in zip(texts, plain([t for _, t in texts], 200)))


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for trial in range(12):
        data = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(5, 120)).astype(np.uint8)
        data = np.tile(data, 3) if trial % 3 == 0 else data
        body, got = bytes(data), repeats.matching_statistics(data, 1024)
        for i in range(len(body)):
            most = max((k for j in range(len(body)) if j != i for k in range(len(body) - max(i, j) + 1) if body[i : i + k] == body[j : j + k]), default=0)
            assert got[i] == most


def test_bit_map(spark):
    rng = np.random.default_rng(5)
    names = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    table = spark.createDataFrame([(int(n),) for n in names.view(np.int64)], "name long")
    known = repeats.bit_map(table, 1 << 20)
    assert repeats.in_map(names, known).all()
    assert repeats.in_map(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64), known).mean() < 0.004


def test_copies_of_every_number(spark):
    """A text that occurs once, twice, three times and often, within a task and across tasks."""
    rng = random.Random(6)
    texts = [body for n in (1, 2, 3, 40) for body in [prose(rng, 120)] for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(str((k, *w)) for k, w in enumerate(plain(texts, 200)))
    for parts in (1, 7):
        got = sorted(str(tuple(r)) for r in repeats.remove(docs.repartition(parts)).collect())
        assert got == want


def test_the_index_marks_the_starts(spark, texts):
    """Matching statistics over the kinds of all pieces find every repeated string; the query has as many starts."""
    bodies = [(t or "").encode() for _, t in texts]
    kinds = Counter()
    for body in (b for b in bodies if len(b) >= 200):
        _, _, start, n, _, _, _ = repeats.pieces_of([body], 200)
        kinds.update(body[s : s + m + 199] for s, m in zip(start.tolist(), n.tolist(), strict=True))
    several, starts = np.array([c > 1 for c in kinds.values()]), np.array([len(b) - 199 for b in kinds])
    _, _, run = repeats.kinds_repeated(list(kinds), several, starts, 200)
    count = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    assert run.sum() == sum(count[b[i : i + 200]] > 1 for b in kinds for i in range(len(b) - 199))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert repeats.repeated_starts(docs).agg({"n": "sum"}).first()[0] == sum(c for c in count.values() if c > 1)


def test_small_batches(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(str(r) for r in repeats.remove(docs).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(str(r) for r in repeats.remove(docs).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark, nothing):
    assert repeats.remove(nothing).count() == 0
