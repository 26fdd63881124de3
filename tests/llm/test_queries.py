from __future__ import annotations

import duckdb
import pytest

from sparkloom.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = q.queries()[name](spark, DATA), con.sql(q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda listed, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in listed)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "repeats", "pack"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0
