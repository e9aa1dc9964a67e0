"""Epoch-aligned buckets and the aggregates inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import labels_of

AGGREGATES = ("avg", "min", "max", "sum", "count", "rate", "last", "first")
TEXT_AGGREGATES = ("last", "first", "count")
SERIES = ["metric", "series_key"]


def bucket(width: int, ts: str = "ts") -> Column:
    """Start of the bucket; integer division cuts towards zero."""
    return F.expr(f"({ts} div {int(width)}L) * {int(width)}L")


def _value(name: str) -> Column:
    later = F.struct("ts", "seq")
    plain = {
        "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "sum": F.sum("value"), "count": F.count("value"),
        "last": F.max_by("value", later),  # of equal times the one that arrived last
        "first": F.min_by("value", F.struct(F.col("ts"), (-F.col("seq")).alias("late"))),
    }
    return plain[name]


def bucketed(points: DataFrame, width: int, name: str) -> DataFrame:
    """(metric, series_key, labels, bucket, value) of every series and bucket that has points."""
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    rows = points.withColumn("bucket", bucket(width))
    keys = [*SERIES, "bucket"]
    if name == "rate":
        # Positive steps over the time of the pairs they come from; pairs across resets or without time are left out.
        order = Window.partitionBy(*keys).orderBy(F.col("ts"), F.col("seq").desc())
        rows = rows.withColumn("dv", F.col("value") - F.lag("value").over(order)).withColumn("dt", F.col("ts") - F.lag("ts").over(order))
        good = (F.col("dv") >= 0) & (F.col("dt") > 0)
        agg = F.coalesce(F.sum(F.when(good, F.col("dv"))) / F.sum(F.when(good, F.col("dt"))), F.lit(0.0))
    else:
        agg = _value(name)
    return rows.groupBy(*keys).agg(agg.alias("value")).select("metric", "series_key", labels_of().alias("labels"), "bucket", "value")


def merged(series: DataFrame, keys: list[Column], how: str | None = "max") -> DataFrame:
    """Second stage: values of several series in one bucket; avg is the mean of the series' values."""
    agg = {"max": F.max("value"), "min": F.min("value"), "sum": F.sum("value"), "avg": F.avg("value"), "count": F.count("value").cast("double")}[how or "max"]
    return series.groupBy(*keys, "bucket").agg(agg.alias("value"))
