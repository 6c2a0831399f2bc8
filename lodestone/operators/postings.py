"""A persisted inverted index: keyword queries read the postings of their words, not the texts.

The postings are one table sorted by term across its files, so the statistics of its
row groups let a scan skip all but those of the words asked for, and of a prefix likewise.
A word on very many rows spreads over several files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens
from lodestone.sources.shared import exists, remove, shared_dir, version_of

#: Rows of a row group: small ones, as a query wants few terms.
GROUP_BYTES = 4 << 20
#: Words that a task groups at once, but for a longer row.
WORDS = 1 << 19


@dataclass
class Postings:
    """postings: term, row, id, project, dl (length of the row in tokens), at (places from 1); sizes: project, docs, words."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, row, id, project, dl, at of rows with their words t: a list for each word of a row, and one without a term for the row."""
    for whole in batches:
        sizes = pc.fill_null(pc.list_value_length(whole.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, np.diff(np.cumsum(sizes) // WORDS) > 0)), whole.num_rows) if whole.num_rows else [0]
        for i, j in zip(edges, edges[1:]):
            batch, n = whole.slice(i, j - i), sizes[i:j]
            words = batch.column(3).flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n) + 1
            key = doc * max(1, len(words.dictionary)) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            held = order[first]
            take = pa.array(np.concatenate([doc[held], np.arange(len(n))]))
            term = pa.concat_arrays([words.dictionary.take(pa.array(code[held])).cast(pa.string()), pa.nulls(len(n), pa.string())])
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([first, np.full(len(n) + 1, len(key))]), pa.int32()), pa.array(at[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([term, *[batch.column(c).take(take) for c in range(3)], pa.array(n, pa.int32()).take(take), places], names=["term", "row", "id", "project", "dl", "at"])


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", project_col: str | None = None) -> Postings:
    """Index every row of ``docs`` under ``path``; what an earlier attempt left there is replaced.

    Null and empty texts count as rows of length 0; repeated ids are rows of their own.
    """
    project = F.col(project_col).cast("string") if project_col else F.lit("all")
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), project.alias("project"), tokens(F.col(text_col)).alias("t"))
    # A row's places of a word are all in that row: lists are made where its text is cut, once, and only they are sorted.
    schema = T.StructType([T.StructField("term", T.StringType()), *[rows.schema[c] for c in ("row", "id", "project")], T.StructField("dl", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    rows.mapInArrow(_lists, schema).write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.schema(schema).parquet(f"{path}/lists")
    lists.filter("term is not null").repartitionByRange("term", "row").sortWithinPartitions("term", "row").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    lists.filter("term is null").groupBy("project").agg(F.count("*").alias("docs"), F.sum("dl").alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    remove(spark, f"{path}/lists")
    return Postings(spark, path)


def of_version(spark: SparkSession, tables: list[str], id_col: str, text_col: str, project_col: str | None) -> Postings:
    """The index of stored tables that never change under their names, as versions of a store don't."""
    key = hashlib.sha256("\n".join([*sorted(tables), id_col, text_col, project_col or ""]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/lodestone-index/{key}"
    return Postings(spark, path) if exists(spark, f"{path}/sizes/_SUCCESS") else build(spark.read.parquet(*tables), path, id_col, text_col, project_col)


def of_table(spark: SparkSession, table: str, id_col: str = "doc_id", text_col: str = "text", project_col: str | None = None) -> Postings:
    """The index of a stored table's present version, built in the shared folder when first asked for."""
    key = hashlib.sha256("\n".join([version_of(spark, table), id_col, text_col, project_col or ""]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/lodestone-index/{key}"
    if exists(spark, f"{path}/sizes/_SUCCESS"):
        return Postings(spark, path)
    return build(spark.read.parquet(table), path, id_col, text_col, project_col)
