"""Daily rollup behind a watermark, retention, ring buffers and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import labels_of
from tidemark.operators.aggregates import bucket

DAY = 86400


def daily_rows(points: DataFrame, watermark: int, now: int) -> DataFrame:
    """Rollup rows of the completed UTC days after the watermark's day; days before it are never computed again."""
    today = now // DAY * DAY
    rows = points.withColumn("bucket", bucket(DAY)).where((F.col("bucket") > watermark) & (F.col("bucket") < today))
    # ``last``: of equal times the one that arrived first.
    last = F.max_by("value", F.struct(F.col("ts"), (-F.col("seq")).alias("early")))
    return rows.groupBy("metric", "series_key", "bucket").agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"), F.sum("value").alias("sum"), last.alias("last")
    ).select("metric", "series_key", labels_of().alias("labels"), "bucket", "avg", "min", "max", "count", "sum", "last")


def next_watermark(watermark: int, now: int) -> int:
    """Start of the last completed day; it never moves back."""
    return max(watermark, now // DAY * DAY - DAY)


def roll(points: DataFrame, tier: DataFrame, watermark: int, now: int) -> tuple[DataFrame, int]:
    """The rollup table with new days put in or replaced, and the new watermark."""
    fresh = daily_rows(points, watermark, now)
    keys = ["metric", "series_key", "bucket"]
    return tier.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), next_watermark(watermark, now)


def retain(points: DataFrame, now: int, raw_seconds: int = 7 * DAY) -> DataFrame:
    """Points that are not older than the retention."""
    return points.where(F.col("ts") >= now - raw_seconds)


def retain_daily(tier: DataFrame, now: int, daily_seconds: int = 365 * DAY) -> DataFrame:
    return tier.where(F.col("bucket") >= now - daily_seconds)


def orphans(series: DataFrame, points: DataFrame) -> DataFrame:
    """Series that have no points left."""
    return series.join(points.select("metric", "series_key").distinct(), ["metric", "series_key"], "left_anti")


def ring_buffer(points: DataFrame, block_size: int = 1000, max_blocks: int = 100) -> DataFrame:
    """The newest ``max_blocks`` full blocks of each series by arrival, and the unfinished block after them."""
    series = Window.partitionBy("metric", "series_key")
    rows = points.withColumn("__block", F.expr(f"(row_number() over (partition by metric, series_key order by seq) - 1) div {block_size}"))
    rows = rows.withColumn("__n", F.count("*").over(series)).withColumn("__full", F.expr(f"__n div {block_size}"))
    return rows.where(F.col("__block") >= F.col("__full") - max_blocks).drop("__block", "__n", "__full")


def compact(points: DataFrame, path: str, files: int) -> DataFrame:
    """The same points rewritten to ``path`` as few files, clustered by series and time."""
    points.repartitionByRange(files, "metric", "series_key", "ts").sortWithinPartitions("metric", "series_key", "ts").write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path)
