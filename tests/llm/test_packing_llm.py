from itertools import combinations

import numpy as np

from tideline.llm.packing import optimal_bounds, pack

from .conftest import nasty_texts


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 9, replace=False))
        counts = rng.integers(1, 9, 9)
        for k in (1, 2, 3, 4):
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))
            got = optimal_bounds(lengths, counts, k)
            assert padding(lengths, counts, got) == best and len(got) <= k
    assert optimal_bounds(np.array([]), np.array([]), 3) == []


def test_batches(spark, nasty, nothing):
    budget = 300
    got = pack(nasty, budget, 4).toPandas()
    assert len(got) == len(nasty_texts())
    assert sorted(got["n_tokens"]) == sorted(len((t or "").encode().split()) for _, t in nasty_texts())
    assert (got["n_tokens"] <= got["bucket_len"]).all()
    for (bucket, batch), rows in got.groupby(["bucket", "batch"]):
        assert sorted(rows["place"]) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * max(rows["bucket_len"]) <= budget
    for bucket, rows in got.groupby("bucket"):
        full = rows.groupby("batch").size().sort_index()
        assert list(full.index) == list(range(len(full)))
        assert full.iloc[:-1].nunique() <= 1
    assert pack(nothing, budget, 4).count() == 0


def test_lengths_and_bins(spark):
    docs = spark.createDataFrame([(i, " a" * i) for i in (0, 1, 5, 2048, 2049, 4097, 9001)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.bucket_len) for r in pack(docs, 1000, 10).collect()}
    assert all(v[0] == k and k <= v[1] <= k * (1 + 1 / 1024) + 1 for k, v in got.items())
