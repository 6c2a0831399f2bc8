"""Incremental maintenance as a stream: snapshot batches merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relations import upsert


def merge_batches(spark: SparkSession, source: DataFrame, root: str, keys: list[str], checkpoint: str):
    """Start a query that merges each batch into a new version of a table under ``root``.

    A batch writes version id + 1 from version id, so a repeated batch rewrites the same
    version and changes nothing; rows with ``deleted`` true go. Of several rows of a key in
    one batch the greatest by the other columns, in their order, is taken.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        # Of several rows of a key in one batch the greatest counts, so that a repeated batch gives the same.
        new = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
        live, gone = new.filter("not deleted").drop("deleted"), new.filter("deleted").select(*keys)
        if batch_id:
            old = s.read.parquet(f"{root}/v{batch_id}").join(gone, keys, "left_anti")
            live = upsert(old, live, keys)
        live.write.mode("overwrite").parquet(f"{root}/v{batch_id + 1}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and type under a watermark; a native extra over event tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
