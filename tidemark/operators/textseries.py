"""Run-length encoding of text series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(points: DataFrame) -> DataFrame:
    """(metric, series_key, labels, run, start_ts, timestamps, seqs, value): one row for each run of equal values."""
    order = Window.partitionBy("metric", "series_key").orderBy("ts", "seq")
    new = F.when(F.lag("value").over(order).eqNullSafe(F.col("value")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    runs = points.withColumn("__new", new).withColumn("run", F.sum("__new").over(order))
    grouped = runs.groupBy("metric", "series_key", "run").agg(F.any_value("labels").alias("labels"), F.any_value("value").alias("value"), F.array_sort(F.collect_list(F.struct("ts", "seq"))).alias("__at"))
    return grouped.select("metric", "series_key", "labels", "run", F.element_at("__at", 1).ts.alias("start_ts"), F.col("__at.ts").alias("timestamps"), F.col("__at.seq").alias("seqs"), "value")


def decode(runs: DataFrame) -> DataFrame:
    """The points that were encoded."""
    rows = runs.select("metric", "labels", "series_key", "value", F.explode(F.arrays_zip("timestamps", "seqs")).alias("__p"))
    return rows.select("metric", "labels", "series_key", F.col("__p.timestamps").alias("ts"), "value", F.col("__p.seqs").alias("seq"))
