"""Streams of points: append to a table, live bucket aggregates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(stream: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Appends every micro-batch of points to a Parquet table by metric, day and batch.

    Late, unordered and repeated points are all kept, as in batch writes.  A batch that is
    run again after a failure replaces what it wrote before.
    """
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parse(batch) if parse else batch
        rows = rows.withColumn("day", F.expr("ts div 86400")).withColumn("batch", F.lit(f"{stream_name}-{batch_id}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_buckets(stream: DataFrame, width: int, lateness: int = 0, watermark: str = "10 minutes") -> DataFrame:
    """Running avg, min, max, sum and count of every series and bucket, for update mode; buckets are dropped once the watermark has passed them."""
    rows = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{lateness} seconds" if lateness else watermark)
    out = rows.groupBy("metric", "series_key", F.window("at", f"{width} seconds").alias("w")).agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count("value").alias("count"))
    return out.select("metric", "series_key", F.unix_timestamp("w.start").alias("bucket"), "avg", "min", "max", "sum", "count")
