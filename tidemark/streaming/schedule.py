"""Periodic work (rollups, retention, alerts, own statistics) as streams of ticks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import LABELS, points


def every(spark: SparkSession, seconds: int, run: Callable[[int], None]) -> StreamingQuery:
    """Calls ``run(now)`` each ``seconds``; the stream only keeps time.  Micro-batches begin at multiples of the interval, as Spark's trigger aligns them."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def work(batch: DataFrame, _: int) -> None:
        latest = batch.agg(F.max(F.unix_timestamp("timestamp"))).first()[0]
        if latest is not None:
            run(int(latest))

    return ticks.writeStream.foreachBatch(work).trigger(processingTime=f"{seconds} seconds").start()


def own_statistics(spark: SparkSession, now: int, counters: Mapping[str, float], before: Mapping[str, float] | None = None, seconds: float = 0.0) -> DataFrame:
    """Points of the engine's own counters, and their rates since the snapshot before."""
    rows = [(f"tidemark_{k}_total", float(v)) for k, v in counters.items()]
    if before is not None and seconds > 0:
        rows += [(f"tidemark_{k}_per_second", max(0.0, v - before.get(k, 0.0)) / seconds) for k, v in counters.items()]
    df = spark.createDataFrame([(m, v, i) for i, (m, v) in enumerate(rows)], "metric string, value double, seq long")
    return points(df, F.col("metric"), F.create_map().cast(LABELS), F.lit(now), F.col("value"), F.col("seq"), ordered=True)


def store_counters(store) -> dict[str, float]:
    """Numbers of series and points that a store holds, for ``own_statistics``."""
    info = store.info().first()
    return {"series": float(info["series_count"]), "points": float(info["total_points"])}
