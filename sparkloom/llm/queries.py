"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import chat_format, jaccard_join, language_id, near_vectors, packing, piece_codec, quality_model, quality_rules, repeat_spans, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.op1_near_vectors(table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op2_chat_format(spark, table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op3_language_id(table(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.op4_piece_codec(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op5_quality_rules(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6_packing(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op8_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_spans.op9_repeat_spans(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op10_jaccard_join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_vectors": op1_near_vectors,
        "op2_chat_format": op2_chat_format,
        "op3_language_id": op3_language_id,
        "pages_language_id": pages_language_id,
        "op4_piece_codec": op4_piece_codec,
        "op5_quality_rules": op5_quality_rules,
        "op6_packing": op6_packing,
        "op7_toxicity": op7_toxicity,
        "op8_quality_model": op8_quality_model,
        "op9_repeat_spans": op9_repeat_spans,
        "op10_jaccard_join": op10_jaccard_join,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_vectors": near_vectors.op1_sql(),
        "op2_chat_format": chat_format.op2_sql(),
        "op5_quality_rules": quality_rules.op5_sql(),
        "op10_jaccard_join": jaccard_join.op10_sql(),
    }
