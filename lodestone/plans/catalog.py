"""All registered queries of the retrieval engine and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import combined, relational, retrieval, texts  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_search(spark, sf_dir)
