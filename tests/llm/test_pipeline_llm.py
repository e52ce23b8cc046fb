import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tideline.llm import decontaminate, line_dedup, simhash

from .conftest import SF


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage reads and gives, written as the driver does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_stages_follow_their_operators(stages, spark):
    before, after = stages["language_id"]
    with_letters = before.where(F.col("text").rlike(r"\p{L}"))
    assert set(ids(after)) <= set(ids(with_letters)) and after.count() >= 0.98 * with_letters.count()
    before, after = stages["line_dedup"]
    want = line_dedup.deduplicate(before).select("doc_id", "text", F.length("text").alias("n"))
    assert sorted(want.collect()) == sorted(after.select("doc_id", "text", "n_chars").collect())
    before, after = stages["simhash_dedup"]
    groups = simhash.groups(before).toPandas()
    assert ids(after) == sorted(groups["component_id"].unique())
    before, after = stages["decontamination"]
    found = {r.k for r in decontaminate.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert found and ids(after) == [i for i in ids(before) if i not in found]
    before, after = stages["packing"]
    assert ids(after) == ids(before)


def test_run_gives_the_last_stage(stages, spark):
    assert sorted(pipeline.run(spark, SF).collect()) == sorted(stages["packing"][1].collect())


def test_nasty_rows(spark, nasty, nothing):
    for name, stage in pipeline.STAGES[1:]:
        got = stage(spark, nasty, SF)
        assert name == "packing" or got.columns == nasty.columns
        got.count()
        stage(spark, nothing, SF).count()
