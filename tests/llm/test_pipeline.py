from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.frames import documents
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    from tests.check_queries import difference, duck

    ours = QUERIES[name](spark, SF).toPandas()
    assert difference(ours, duck(SF).execute(ORACLES[name]).df()) is None


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert docs.columns == columns
        if name not in ("mixing", "byte_bpe"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where(~F.col("round_trip")).count() == 0
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(r.n_tokens for r in ran.collect()) == sorted(r.n_tokens for r in docs.collect())


def test_stages_take_empty_tables(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
