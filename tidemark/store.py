"""A store of points in Parquet tables, partitioned by metric and day."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import POINTS, TEXT_POINTS, points, text_points
from tidemark.operators import catalog, rollup
from tidemark.session import ensure

_ENTRY = "metric string, labels map<string,string>, value double, ts long, seq long"


class Store:
    """Writes and reads the tables below ``path``; queries take the DataFrames that it returns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ensure(spark), path.rstrip("/")
        self._next = 0

    def arrivals(self, n: int) -> int:
        """The first of ``n`` numbers above all that this store gave out before; by the clock, so that they also follow those of earlier processes."""
        first = max(time.time_ns(), self._next)
        self._next = first + n
        return first

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, schema) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def control(self, name: str, schema: str) -> DataFrame:
        """A small table of the store (rules, states, targets, annotations, metadata): its newest version."""
        n = self._version(name)
        return self._read(f"{name}/version={n}", self.spark.createDataFrame([], schema).schema)

    def replace(self, name: str, table: DataFrame) -> None:
        """Writes a small table as its next version; readers of the one before are not disturbed."""
        table.coalesce(1).write.parquet(f"{self.path}/{name}/version={self._version(name) + 1}")

    def _version(self, name: str) -> int:
        if not self._exists(name):
            return 0
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return max((int(x.split("=")[1]) for x in found if x.startswith("version=") and self._exists(f"{name}/{x}/_SUCCESS")), default=0)

    def points(self) -> DataFrame:
        return self._read("points", POINTS)

    def text(self) -> DataFrame:
        return self._read("text_points", TEXT_POINTS)

    def between(self, start: int, end: int) -> DataFrame:
        """The points in [start, end]; only the folders of these days are read."""
        return self._days(start // 86400, end // 86400).where(F.col("ts").between(start, end))

    def _days(self, first: int, last: int) -> DataFrame:
        """The points of these days' folders."""
        if not self._exists("points"):
            return self.spark.createDataFrame([], POINTS)
        rows = self.spark.read.schema(T.StructType([*POINTS.fields, T.StructField("day", T.LongType())])).parquet(f"{self.path}/points")
        return rows.where(F.col("day").between(first, last)).select(*POINTS.names)

    def append(self, df: DataFrame, name: str = "points") -> None:
        """Appends points, clustered so that row groups of a file can be skipped by series and time.

        A day of a metric is one file; only where it is larger than a task should read (by the size
        that the shuffle measured) is it split among tasks.  So files follow days and bytes, and no
        metric is written by one task.
        """
        rows = df.withColumn("day", F.expr("ts div 86400")).hint("rebalance", "metric", "day").sortWithinPartitions("metric", "day", "series_key", "ts")
        rows.write.mode("append").partitionBy("metric", "day").parquet(f"{self.path}/{name}")

    def write_batch(self, entries: Iterable[tuple], now: int, first_seq: int | None = None) -> None:
        """Entries (metric, labels, value) or (metric, labels, value, ts); without a time it is now.  Strings become text points.

        Entries count as arrived in their order, after all that were written before (or from ``first_seq``).
        """
        entries = list(entries)
        first_seq = self.arrivals(len(entries)) if first_seq is None else first_seq
        rows = [(e[0], {k: str(v) for k, v in e[1].items()}, e[2], int(e[3]) if len(e) > 3 and e[3] is not None else now, first_seq + i) for i, e in enumerate(entries)]
        numbers = [(m, labels, float(v), t, s) for m, labels, v, t, s in rows if not isinstance(v, str)]
        strings = [r for r in rows if isinstance(r[2], str)]
        c = F.col
        for some, schema, make, name in ((numbers, _ENTRY, points, "points"), (strings, _ENTRY.replace("value double", "value string"), text_points, "text_points")):
            if some:
                self.append(make(self.spark.createDataFrame(some, schema), c("metric"), c("labels"), c("ts"), c("value"), c("seq")), name)

    def write(self, metric: str, labels: Mapping[str, str], value: float | str, now: int, ts: int | None = None, seq: int | None = None) -> None:
        self.write_batch([(metric, labels, value, ts)], now, seq)

    def rollup(self, watermark: int, now: int) -> int:
        """Appends the days completed since the watermark and returns the new one; days that are there already stay as they are."""
        # Days are cut towards zero like buckets: those after the watermark and before now are in these folders.
        fresh = rollup.daily_rows(self._days(watermark // 86400, now // 86400), watermark, now)
        fresh = fresh.join(self.daily().select("metric", "series_key", "bucket"), ["metric", "series_key", "bucket"], "left_anti").select(*fresh.columns)
        fresh.write.mode("append").parquet(f"{self.path}/tier_daily")
        return rollup.next_watermark(watermark, now)

    def daily(self) -> DataFrame:
        from tidemark.model import DAILY

        return self._read("tier_daily", self.spark.createDataFrame([], DAILY).schema)

    def info(self) -> DataFrame:
        return catalog.store_info(self.points())
