"""Edges as neighbour lists by dense node numbers, read whole in each round of a graph loop.

A loop keeps one value a node on the driver, broadcasts it and gets back one value a list
owner, so that a round shuffles no edge. That holds for at most ``NODES`` nodes; loops over
more fall back on joins. Lists are cut into pieces of ``PIECE`` edges, whatever a node's degree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.shared import remove, shared_dir

#: Nodes whose values the driver and each task hold at once (80 MB a vector of doubles).
NODES = 10_000_000
#: Edges that a task groups at once, edges of a stored list, nodes of a slice of the result.
ROWS, PIECE, SLICE = 1 << 21, 1 << 18, 1 << 16
BATCH_BYTES = 8 << 20
LIST = "piece long, own binary, starts binary, at binary, w binary"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table of the shared folder, deleted at the end of the block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-graph/{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` for the jobs of the block: a row is up to a whole list."""
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BYTES)
        else:
            spark.conf.set(_BYTES, before)


def numbers(df: DataFrame) -> list[np.ndarray]:
    """Every column of a table of numbers on the driver, packed by the tasks; for one row a node."""
    n = len(df.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(b.column(i).to_numpy(zero_copy_only=False)).tobytes()], pa.binary()) for i in range(n)], names=[f"c{i}" for i in range(n)])

    rows = df.mapInArrow(pack, ", ".join(f"c{i} binary" for i in range(n))).collect()
    kinds = [np.float64 if isinstance(f.dataType, T.DoubleType) else np.int64 for f in df.schema]
    return [np.concatenate([np.frombuffer(r[i], k) for r in rows] or [np.empty(0, k)]) for i, k in enumerate(kinds)]


def frame(spark: SparkSession, schema: str, columns: list[np.ndarray]) -> DataFrame:
    """A table of the driver's vectors, made by tasks in slices."""
    shared = spark.sparkContext.broadcast(columns)
    n = -(-len(columns[0]) // SLICE)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c[i * SLICE : (i + 1) * SLICE]) for c in shared.value], names=names)

    return spark.range(0, n, 1, max(1, min(n, 64))).mapInArrow(rows, schema)


@dataclass
class Lists:
    """ids: sorted node ids, whose places are the nodes' numbers; owners: the numbers of each stored piece's owners."""

    spark: SparkSession
    table: DataFrame
    ids: np.ndarray
    owners: dict[int, np.ndarray]

    def visit(self, vector: np.ndarray, work: Callable) -> list[tuple[int, bytes]]:
        """piece and result of ``work(vector, owners, starts, neighbours, weights or None)`` for every piece."""
        shared = self.spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                done = []
                for i in range(b.num_rows):
                    own, starts, at = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in (1, 2, 3))
                    w = b.column(4)[i].as_buffer()
                    done.append(work(shared.value, own, starts, at, None if w is None else np.frombuffer(w, np.float64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.binary())], names=["piece", "done"])

        with _small_batches(self.spark):
            rows = self.table.mapInArrow(run, "piece long, done binary").collect()  # one value an owner
        shared.destroy()
        return [(r.piece, r.done) for r in rows]


@contextmanager
def lists(edges: DataFrame, more: np.ndarray) -> Iterator[Lists | None]:
    """Lists of edges (a: the owner, b: the neighbour, w) by a, deleted at the end of the block; None if there are too many nodes.

    Nodes are all owners and those in ``more``; other neighbours have the number ``len(ids)``.
    """
    spark = edges.sparkSession
    path = f"{shared_dir(spark)}/lodestone-graph/{uuid.uuid4().hex}"

    def grouped(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        for i in range(0, len(a), PIECE):
            mine, part = a[i : i + PIECE], w[i : i + PIECE]
            starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            yield len(starts), mine[starts].tobytes(), starts.astype(np.int32).tobytes(), b[i : i + PIECE].tobytes(), None if (part == 1).all() else part.tobytes()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in grouped(*(np.concatenate(x) for x in zip(*kept, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["n", "own", "starts", "at", "w"])

        for batch in batches:
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= ROWS:
                yield from out()
                kept, size = [], 0
        if size:
            yield from out()

    try:
        dealt = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")).filter("a is not null and b is not null").repartition("a")
        raw = dealt.mapInArrow(group, "n long, own binary, starts binary, at binary, w binary").withColumn("piece", F.monotonically_increasing_id())
        raw.write.parquet(f"{path}/raw")
        raw = spark.read.schema(f"n long, {LIST}").parquet(f"{path}/raw")
        if (raw.agg(F.sum("n")).first()[0] or 0) + len(more) > 2 * NODES:  # an owner can stand in two pieces
            yield None
            return
        own = {r.piece: np.frombuffer(r.own, np.int64) for r in raw.select("piece", "own").collect()}  # one number an owner
        ids = np.unique(np.concatenate([more.astype(np.int64), *own.values()]))
        if len(ids) > NODES:
            yield None
            return
        shared = spark.sparkContext.broadcast(ids)

        def place(x: np.ndarray) -> np.ndarray:
            if not len(shared.value):
                return np.zeros(len(x), np.int32)
            at = np.searchsorted(shared.value, x)
            return np.where(shared.value[np.minimum(at, len(shared.value) - 1)] == x, at, len(shared.value)).astype(np.int32)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, at = ([place(np.frombuffer(x.as_buffer(), np.int64)).tobytes() for x in b.column(c)] for c in (1, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), b.column(2), pa.array(at, pa.binary()), b.column(4)], names=["piece", "own", "starts", "at", "w"])

        with _small_batches(spark):
            raw.select("piece", "own", "starts", "at", "w").mapInArrow(number, LIST).write.option("parquet.block.size", 16 << 20).parquet(f"{path}/lists")
        shared.destroy()
        remove(spark, f"{path}/raw")
        yield Lists(spark, spark.read.schema(LIST).parquet(f"{path}/lists"), ids, {p: np.searchsorted(ids, x).astype(np.int32) for p, x in own.items()})
    finally:
        remove(spark, path)


def pagerank(edges: DataFrame, seeds: np.ndarray, each: float, rounds: int, alpha: float, tolerance: float | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Node ids and their scores as of ``graph.personalized_pagerank`` (edges: src, dst, weight; each seed gets ``each``); None if there are too many nodes."""

    def flow(q: np.ndarray, own, starts, at, w) -> bytes:
        got = q[at]
        return np.add.reduceat(got if w is None else got * w, starts).tobytes()

    with lists(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("w")), seeds) as found:
        if found is None:
            return None
        ids, n = found.ids, len(found.ids)
        src, total = numbers(edges.groupBy(F.col("src").cast("long").alias("src")).agg(F.sum(F.col("weight").cast("double")).alias("total")).filter("src is not null and total <> 0"))
        at = np.minimum(np.searchsorted(ids, src), n - 1)
        known = ids[at] == src  # a source that nothing reaches has no score to pass on
        share = np.zeros(n + 1)
        share[at[known]] = (1 - alpha) / total[known]
        start = np.zeros(n)
        start[np.searchsorted(ids, seeds)] = each
        p = start
        for _ in range(rounds):
            new = start * alpha
            for piece, done in found.visit(share * np.append(p, 0.0), flow):
                new[found.owners[piece]] += np.frombuffer(done, np.float64)  # an owner stands once in a piece
            p, old = new, p
            if tolerance is not None and np.linalg.norm(p - old) < tolerance:
                break
        return ids, p


def components(both: DataFrame, more: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Node ids and the smallest id that each reaches, of edges (a, b) given both ways; None if there are too many nodes.

    In a round every node names the smallest other label among its neighbours, so each part
    that is not whole yet meets another one, and their number at least halves.
    """

    def differing(label: np.ndarray, own, starts, at, _) -> bytes:
        near, mine = label[at], label[own]
        near = np.where(near == np.repeat(mine, np.diff(np.append(starts, len(at)))), len(label), near)
        low = np.minimum.reduceat(near, starts)
        pairs = np.unique(mine[low < len(label)].astype(np.int64) << 32 | low[low < len(label)])
        return pairs.tobytes()

    with lists(both.withColumn("w", F.lit(1.0)), more) as found:
        if found is None:
            return None
        label = np.arange(len(found.ids), dtype=np.int32)
        while True:
            pairs = np.concatenate([np.frombuffer(done, np.int64) for _, done in found.visit(label, differing)] or [np.empty(0, np.int64)])
            if not len(pairs):
                return found.ids, found.ids[label]
            a, b = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
            while (open_ := label[a] != label[b]).any():
                a, b = a[open_], b[open_]
                x, y = label[a], label[b]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != (jump := label[label])).any():
                    label = jump
