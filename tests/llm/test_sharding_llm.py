import zlib

from tideline.llm.sharding import place

from .conftest import nasty_texts

EVEN = {s: 1.0 for s in range(9)}


def test_every_row_once_and_slots_without_gaps(spark, nasty):
    got = place(nasty, {s: 1.0 for s in range(8)}, EVEN).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in nasty_texts()
    )
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    assert {r.law for r in got} == {"key"}


def test_growth_weights_and_empty(spark, nothing):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    got = place(docs, {s: 1.0 for s in range(8)}, EVEN).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {8} and 0.09 < len(moved) / len(got) < 0.13
    assert (got.groupby("shard").size() / len(got)).between(0.11, 0.14).all()
    heavy = place(docs, {0: 3.0, 1: 1.0}, EVEN).toPandas()
    assert 0.73 < (heavy["shard"] == 0).mean() < 0.77
    assert place(nothing, {0: 1.0}, EVEN).count() == 0
