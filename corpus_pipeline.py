"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; their decisions take effect on the next stage's rows and texts. Between
stages, run() writes the rows to the shared folder and reads them back, so that no stage is computed twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import jaccard_join, language_id, packing, quality_rules, repeat_spans
from sparkloom.llm.shared import TEXT_ROWS, few, remove, scratch, staging

#: Tables that the latest stage over each folder of inputs has staged.
_held: dict[tuple[str, str], list[str]] = {}


def _tidy(stage):  # noqa: ANN001, ANN202
    """A stage that removes what the stage before it over the same inputs has staged, since that one's result is written by now."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _held.pop((spark.sparkContext.applicationId, sf_dir), []):
            remove(spark, path)
        with staging() as own:
            out = few(stage(spark, docs, sf_dir), docs.count(), TEXT_ROWS)
        _held[spark.sparkContext.applicationId, sf_dir] = own
        return out

    return run_stage


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in no known language."""
    return language_id.kept_documents(docs)


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules, and those of failing hosts."""
    return quality_rules.kept_documents(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, the one with the least doc_id; among repeated rows, one."""
    return jaccard_join.one_of_each(docs)


@_tidy
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that also stand elsewhere; every row stays."""
    return repeat_spans.without_repeats(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op6 returns them."""
    return packing.op6_packing(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("pack", pack),
]

#: Cutting repeats and packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``. The input of the last stage stays, since the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
