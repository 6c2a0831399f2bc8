"""The stages of the training-data pipeline: each takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import remove_contaminated
from .line_dedup import remove_repeated_passages
from .near_dedup import keep_one
from .packing import pack
from .quality import quality_rules
from .shared import discard, scratch, written
from .token_rollup import count_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document this share of whose words repeats earlier documents is a copy, for the next stage to judge whole.
COPIED_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts are rejected by the base rules. Repeated rows share one
    verdict; null labels teach nothing; an empty table stays empty.
    """
    return quality_rules(docs).filter("kept").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of several lines that stand in earlier documents go from the texts; n_chars follows.

    Copies as a whole stay untouched: what removal would leave of them, nothing or a
    remnant, could no longer be told for a copy by the next stage. So no document becomes
    empty here and none goes. Null texts stay null; rows equal in id and text are one document.
    """
    return remove_repeated_passages(docs, copied_share=COPIED_SHARE).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more over five-word shingles) stays: one row, with the smallest id.

    Rows without words are no one's duplicates and stay.
    """
    return keep_one(docs, 80, 100).select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; null and empty texts have none and stay."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is counted in byte-pair tokens, cut, bucketed by length and batched.

    Documents without tokens give one row of length 0 in no batch.
    """
    counted = count_tokens(docs.select("doc_id", "text")).drop("text")
    return pack(written(counted, "packing-tokens"), length=F.col("n_tokens"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Learned references, sketches and dynamic programming have no SQL form; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage wrote goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if last:
            discard(spark, [last])
        last = docs.table_path
    return docs
