"""Queries over points: filters, buckets, groups, thresholds, top series, latest values.

All operators take and return DataFrames in long form; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.duration import bucket_seconds
from tidemark.functions.matchers import Filter, Matcher, exact, label_filter, metric_filter
from tidemark.functions.transforms import Transform
from tidemark.model import labels_of
from tidemark.operators.aggregates import SERIES, TEXT_AGGREGATES, bucketed, merged

MAX_TS = (1 << 62) - 1


def select(points: DataFrame, metric: str | Matcher | list[str], labels: Filter | None = None, start: int = 0, end: int = MAX_TS) -> DataFrame:
    """Points of matching series in [start, end], both ends included."""
    return points.where(metric_filter(metric) & label_filter(labels) & F.col("ts").between(start, end))


def raw(points: DataFrame, metric: str, labels: Mapping[str, str], start: int = 0, end: int = MAX_TS) -> DataFrame:
    """Points of the one series with exactly these labels, in order of time."""
    return points.where((F.col("metric") == metric) & exact(labels) & F.col("ts").between(start, end)).orderBy("ts", "seq")


def raw_multi(points: DataFrame, metric: str, labels: Filter | None = None, start: int = 0, end: int = MAX_TS) -> DataFrame:
    return select(points, metric, labels, start, end)


def aggregate(points: DataFrame, metric: str, labels: Mapping[str, str], width, name: str = "avg", start: int = 0, end: int = MAX_TS) -> DataFrame:
    """Buckets of one exact series."""
    rows = points.where((F.col("metric") == metric) & exact(labels) & F.col("ts").between(start, end))
    return bucketed(rows, bucket_seconds(width), name)


def aggregate_multi(points: DataFrame, metric: str | Matcher | list[str], labels: Filter | None, width, name: str = "avg", start: int = 0, end: int = MAX_TS, transform: Transform | None = None) -> DataFrame:
    """Buckets of all matching series; points are cut by the range first, so edge buckets may be partial."""
    out = bucketed(select(points, metric, labels, start, end), bucket_seconds(width), name)
    return out.withColumn("value", transform(F.col("value"))) if transform else out


def group_keys(group_by: Sequence[str]) -> list[Column]:
    """Label columns (null where the label is absent); ``__name__`` is the metric."""
    return [(F.col("metric") if k == "__name__" else F.col("labels")[k]).alias(k) for k in group_by]


def aggregate_grouped(points: DataFrame, metric: str | Matcher | list[str], labels: Filter | None, group_by: Sequence[str], width, name: str = "avg", cross: str | None = "max", start: int = 0, end: int = MAX_TS, transform: Transform | None = None) -> DataFrame:
    """Buckets per series, then merged across the series of each group."""
    return merged(aggregate_multi(points, metric, labels, width, name, start, end, transform), group_keys(group_by), cross)


def threshold(series: DataFrame, op: str, limit: float, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Whole series, or groups, of which some bucket passes."""
    every = Window.partitionBy(*keys)
    passes = {">": F.max("value").over(every) > limit, "<": F.min("value").over(every) < limit}[op]
    return series.withColumn("__passes", passes).where("__passes").drop("__passes")


def top_n(series: DataFrame, n: int, order: Column | None = None, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """All buckets of the n series with the largest last value (or ``order``, an aggregate); ties by key."""
    best = series.groupBy(*keys).agg((order if order is not None else F.max_by("value", "bucket")).alias("__rank"))
    best = best.orderBy(F.col("__rank").desc(), *keys).limit(n).drop("__rank")
    same = [series[k].eqNullSafe(best[k]) for k in keys]
    return series.join(F.broadcast(best), same, "left_semi") if n <= 100_000 else series.join(best, same, "left_semi")


def latest(points: DataFrame, metric: str | Matcher | list[str], labels: Filter | None = None, at_most: int | None = None) -> DataFrame:
    """Last point of each matching series; of equal times the one that arrived last."""
    rows = select(points, metric, labels, -MAX_TS, MAX_TS if at_most is None else at_most)
    last = rows.groupBy(*SERIES).agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "seq")).alias("value"))
    return last.select(*SERIES, labels_of().alias("labels"), "ts", "value")


def latest_exact(points: DataFrame, metric: str, labels: Mapping[str, str]) -> DataFrame:
    return latest(points.where(exact(labels)), metric)


def text_aggregate(points: DataFrame, metric: str, labels: Filter | None, width, name: str = "last", start: int = 0, end: int = MAX_TS) -> DataFrame:
    """Buckets of text series: last, first or count."""
    if name not in TEXT_AGGREGATES:
        raise ValueError(f"text series have no {name!r}")
    return bucketed(select(points, metric, labels, start, end), bucket_seconds(width), name)


def daily(tier: DataFrame, metric: str, labels: Mapping[str, str], start: int, end: int) -> DataFrame:
    """Daily rollup rows of one exact series whose day begins in [start, end]."""
    return tier.where((F.col("metric") == metric) & exact(labels) & F.col("bucket").between(start, end)).orderBy("bucket")
