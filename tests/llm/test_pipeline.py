"""The pipeline end to end, and the SQL of the operators that have it."""

import corpus_pipeline
from tests.test_core import same_as_sql
from tidemark.llm import queries
from tidemark.llm.shared import materialize

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_columns_and_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = materialize(out)
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_sql(spark):
    for name, sql in queries.ORACLES.items():
        same_as_sql(spark, queries.QUERIES[name], sql)
