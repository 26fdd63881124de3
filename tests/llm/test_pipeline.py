"""Each stage of the pipeline against a brute-force version on the stage's own input."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from sparkloom.llm import language_id, quality_rules, repeat_spans
from tests.llm.test_small import brute_components

DATA = "/root/testdata/sf0.001"


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cut(texts, width=200):
    """Texts without the bytes of windows that stand twice."""
    data = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - width + 1):
            seen[d[i : i + width]] = seen.get(d[i : i + width], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(np.frombuffer(d, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns

    def written(name):
        path = str(tmp_path / name)
        stages[name](spark, docs, DATA).write.parquet(path)
        made = spark.read.parquet(path)
        assert made.columns == columns
        return made

    kept = {r["doc_id"] for r in language_id.op3_language_id(docs).where("kept").collect()}
    after = written("language")
    assert listed(after) == [r for r in listed(docs) if r[0] in kept] and after.count() >= docs.count() - 2
    docs = after

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    kept = {r[0] for r in con.sql(quality_rules.op5_sql()).fetchall() if r[-1]}
    after = written("quality")
    assert listed(after) == [r for r in listed(docs) if r[0] in kept]
    docs = after

    before = listed(docs)
    least = {c for _, _, c in brute_components([(r[0], r[1]) for r in before])}
    after = written("near_duplicates")
    assert listed(after) == [r for r in before if r[0] in least]
    docs = after

    before = listed(docs)
    texts = cut([r[1] for r in before])
    after = written("repeats")
    assert listed(after) == sorted(((r[0], t, r[2], r[3], len(t)) for r, t in zip(before, texts, strict=True)), key=str)
    assert repeat_spans.digests(docs).agg({"n_removed": "sum"}).first()[0] > 0
    docs = after

    packed = stages["pack"](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in listed(docs)}
    for doc in {r["doc_id"] for r in packed}:
        own = sorted((r for r in packed if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_run_equals_its_stages(spark):
    """run() gives the last stage's rows over what the others leave, and nothing of its own stays but that input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    got = corpus_pipeline.run(spark, DATA)
    tokens = lambda df: {r["doc_id"]: r["doc_tokens"] for r in df.select("doc_id", "doc_tokens").distinct().collect()}
    assert tokens(got) == tokens(want) and got.agg({"length": "sum"}).first()[0] == want.agg({"length": "sum"}).first()[0]
