"""Results as text: json, csv, markdown or file lists, from an ordered (limited) result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def project(results: DataFrame, fields: list[str] | None) -> DataFrame:
    return results.select(*[f for f in fields if f in results.columns]) if fields else results


def formatted(results: DataFrame, kind: str, order: str, fields: list[str] | None = None) -> DataFrame:
    """order and one line per result; ``files`` gives distinct paths in first-seen order; unknown kinds mean json."""
    cols = [c for c in project(results, fields).columns]
    rank = F.col(order).alias("__order")
    if kind == "files":
        return results.groupBy("path").agg(F.min(order).alias("__order")).select("__order", F.col("path").alias("line"))
    if kind == "csv":
        return results.select(rank, F.to_csv(F.struct(*cols)).alias("line"))
    if kind == "markdown":
        return results.select(rank, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |")).alias("line"))
    return results.select(rank, F.to_json(F.struct(*cols)).alias("line"))


def rendered(results: DataFrame, kind: str, order: str, fields: list[str] | None = None) -> str:
    """A limited result as one text: csv with a header of all columns, a table in markdown, lines otherwise."""
    lines = [r.line for r in formatted(results, kind, order, fields).orderBy("__order").collect()]
    names = project(results, fields).columns
    if kind == "csv":
        return "\n".join([",".join(names), *lines]) if lines else ""
    if kind == "markdown":
        return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *lines]) if lines else "*No results found.*"
    return "\n".join(lines) if kind == "files" else "[" + ",\n".join(lines) + "]"


def append_only(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key of an append-only table."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    return df.withColumn("__r", r).filter("__r = 1").drop("__r")
