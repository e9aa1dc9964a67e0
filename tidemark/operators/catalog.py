"""Discovery, metadata, annotations and the state of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matchers import Filter, Matcher, label_filter, metric_filter
from tidemark.model import labels_of

METADATA_TYPES = ("gauge", "counter", "histogram")
METADATA = "metric string, metric_type string, unit string, description string"
ANNOTATIONS = "id long, timestamp long, title string, description string, tags array<string>, created_at long"


def list_metrics(points: DataFrame) -> DataFrame:
    return points.select("metric").distinct().orderBy("metric")


def list_series(points: DataFrame, metric: str | None = None) -> DataFrame:
    """(metric, series_key, labels) of every series."""
    rows = points if metric is None else points.where(F.col("metric") == metric)
    return rows.select("metric", "series_key").distinct().select("metric", "series_key", labels_of().alias("labels")).orderBy("metric", "series_key")


def label_values(points: DataFrame, key: str, metric: str | None = None) -> DataFrame:
    """Distinct values of a label; series without it are skipped."""
    rows = points if metric is None else points.where(F.col("metric") == metric)
    return rows.select(F.col("labels")[key].alias("value")).where("value is not null").distinct().orderBy("value")


def label_names(points: DataFrame) -> DataFrame:
    """All label names and ``__name__``."""
    keys = points.select(F.explode(F.map_keys("labels")).alias("name")).distinct()
    return keys.union(points.sparkSession.range(1).select(F.lit("__name__"))).distinct().orderBy("name")


def match_series(points: DataFrame, metric: str | Matcher | None = None, labels: Filter | None = None) -> DataFrame:
    """Series that a selector matches."""
    where = label_filter(labels) if metric is None else metric_filter(metric) & label_filter(labels)
    return list_series(points.where(where))


def with_metadata(metrics: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metrics with their type, unit and description; a gauge where nothing is registered."""
    return metrics.join(metadata, "metric", "left").select("metric", F.coalesce("metric_type", F.lit("gauge")).alias("metric_type"), "unit", "description")


def register(metadata: DataFrame, metric: str, metric_type: str = "gauge", unit: str | None = None, description: str | None = None) -> DataFrame:
    """Metadata with one row put in or replaced."""
    if metric_type not in METADATA_TYPES:
        raise ValueError(f"unknown metric type {metric_type!r}")
    row = metadata.sparkSession.createDataFrame([(metric, metric_type, unit, description)], METADATA)
    return metadata.where(F.col("metric") != metric).unionByName(row)


def infer_type(metric: str = "metric"):
    """(type, unit) that a metric's suffix stands for; the first match wins."""
    m = F.col(metric)
    # Suffixes and what they stand for.
    kind = F.when(m.endswith("_bytes") | m.endswith("_seconds") | m.endswith("_milliseconds"), "gauge").when(m.endswith("_total") | m.endswith("_count"), "counter").otherwise("gauge")
    unit = F.when(m.endswith("_bytes"), "byte").when(m.endswith("_seconds"), "second").when(m.endswith("_milliseconds"), "millisecond").when(m.endswith("_total") | m.endswith("_count"), F.lit(None)).when(m.endswith("_ratio"), "ratio").when(m.endswith("_percent"), "percent")
    return kind, unit


def store_info(points: DataFrame) -> DataFrame:
    """One row: series_count, total_points, oldest, newest."""
    return points.agg(F.count_distinct("metric", "series_key").alias("series_count"), F.count("*").alias("total_points"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def annotations(table: DataFrame, start: int, end: int, tags: Sequence[str] = ()) -> DataFrame:
    """Annotations in [start, end] that have one of the tags, if any are asked for."""
    rows = table.where(F.col("timestamp").between(start, end))
    if tags:
        rows = rows.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    return rows.orderBy("timestamp", "id")


def add_annotation(table: DataFrame, timestamp: int, title: str, description: str | None = None, tags: Sequence[str] = (), now: int = 0) -> DataFrame:
    """The annotations and a new one, whose id is above all others."""
    if not title:
        raise ValueError("an annotation needs a title")
    row = table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"))
    own = F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")
    row = row.select("id", F.lit(int(timestamp)).cast("long").alias("timestamp"), F.lit(title).alias("title"), F.lit(description).cast("string").alias("description"), own.alias("tags"), F.lit(int(now)).cast("long").alias("created_at"))
    return table.select(*row.columns).unionByName(row)


def delete_annotation(table: DataFrame, annotation_id: int) -> DataFrame:
    return table.where(~F.col("id").eqNullSafe(annotation_id))


def annotate_points(points: DataFrame, table: DataFrame, around: int) -> DataFrame:
    """Points with the annotations at most ``around`` seconds away: an equi-join on time slots, then the exact distance.

    An annotation is put into the three slots that its range can touch, so every point has one slot.
    """
    slot = max(1, around)
    left = points.withColumn("__slot", F.expr(f"floor(ts / {slot})"))
    right = table.withColumn("__slot", F.explode(F.array(*[F.expr(f"floor(timestamp / {slot}) + {k}") for k in (-1, 0, 1)])))
    return left.join(right, "__slot").where(F.abs(F.col("ts") - F.col("timestamp")) <= around).drop("__slot")
