"""The operators' queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, language, line_dedup, near_dedup, packing, quality, sharding, stages, token_rollup, warc


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.corpus_rollup(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


def op2_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive_round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), 85, 100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), drop_text=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.packing_stage(spark, _table(spark, sf_dir, "documents", "doc_id", "text"), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_rollup, op2_warc_merge, op3_feistel_shards, op4_language_id, op5_decontamination]
    own += [op6_near_duplicates, op7_line_dedup, op8_quality_rules, op9_html_text, op10_packing]
    return {f.__name__: f for f in own} | {"pipeline": stages.run}


def oracle_sql() -> dict[str, str]:
    own = {
        "op2_warc_merge": warc.oracle(),
        "op3_feistel_shards": sharding.oracle(),
        "op5_decontamination": decontaminate.oracle(),
        "op6_near_duplicates": near_dedup.oracle(85, 100),
    }
    return own | ({"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {})
