"""What the training-data operators share: written tables, batch limits, dense numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that a task works on at once: the results of long texts must fit a Python worker.
BATCH_ROWS = 64
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Tables written in the innermost ``scratch`` block that is open.
_open: list[list[str]] = []


def prepare(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session does; the rows of a batch stay as they are."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (single-machine tests) is a temporary folder taken, and remembered.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    Inside a ``scratch`` block the table goes when the block ends, unless it is kept.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _open:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables written in the block at its end, but for those given to the yielded function.

    These are passed on to the block around this one, if there is one; otherwise they stay
    in the shared folder for the caller, who reads the result as often as wanted.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.table_path)
        return table

    _open.append(paths)
    try:
        yield keep
    finally:
        _open.remove(paths)
        discard(spark, [p for p in paths if p not in kept])
        if _open:
            _open[-1].extend(kept)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that clash, in any letter case, with the operator's own columns."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[..., list[list]]],
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """Append columns computed batch by batch in Python.

    ``make()`` runs once in each task and returns a function from the lists of
    ``inputs``, of at most ``rows`` rows, to one list per field. Input columns with a field's name are dropped
    from the result, but the function still sees them.
    """
    prepare(df.sparkSession)
    names = [f[0] for f in fields]
    kept = without(df, names).columns
    arrow = [(n, a) for n, _, a in fields]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in fields])
    # The function's inputs travel under names of their own: a clashing input stays readable.
    wide = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(unused(df, f"__in{i}")) for i, c in enumerate(inputs)])
    n_kept, n_in = len(kept), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches, rows):
            got = work(*[batch.column(n_kept + i).to_pylist() for i in range(n_in)])
            columns = [batch.column(i) for i in range(n_kept)]
            columns += [pa.array(v, type=a) for v, (_, a) in zip(got, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[n for n, _ in arrow]])

    return wide.mapInArrow(run, schema)


#: A key met by more than HEAVY_ROWS rows and this part of all rows is joined by a broadcast.
HEAVY_ROWS, HEAVY_KEYS = 1024, 50_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with a written table of one row a key, whose ``count`` says how many rows hold it.

    Very frequent keys, at most HEAVY_KEYS by their share of all rows, are broadcast, so that
    no task gets all rows of one of them; the others are joined by a shuffle.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = table.filter(F.col(count) > least)
    if heavy.isEmpty():
        return rows.join(table, key)
    marked = rows.join(F.broadcast(heavy), key, "left")  # at most total / least rows
    light = marked.filter(F.col(count).isNull()).select(*rows.columns).join(table.filter(F.col(count) <= least), key)
    return marked.filter(F.col(count).isNotNull()).unionByName(light)


def dense_numbers(df: DataFrame, order: list[Column], name: str = "row_no", label: str = "numbers") -> DataFrame:
    """0, 1, 2 ... in the given order, without gathering rows in one task.

    Rows are range-partitioned and sorted, written once with their place in the
    partition, and shifted by the sizes of the partitions before theirs; only those
    sizes (one row a partition) meet in one task. Rows equal in ``order`` get their
    numbers in an arbitrary order.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    sorted_ = (
        df.withColumns(dict(zip(keys, order, strict=True)))
        .withColumn("__tie", F.monotonically_increasing_id() % 4096)
        .repartitionByRange(*keys, "__tie")
        .sortWithinPartitions(*keys)
        .drop(*keys, "__tie")
        .withColumn("__id", F.monotonically_increasing_id())
    )
    table = written(sorted_, label)
    part = F.shiftright("__id", 33)
    sizes = table.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return (
        table.withColumn("__part", part)
        .join(F.broadcast(shifts), "__part")  # one row a partition
        .withColumn(name, F.col("__shift") + F.col("__id") - F.shiftleft("__part", 33))
        .drop("__part", "__id", "__shift")
    )
