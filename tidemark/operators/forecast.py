"""Forecasts and anomalies by least squares on trend and seasonal terms, one series per group.

Series are independent, so each is fitted in a group of its own; what a group holds is
one bucketed series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENSITIVITY = {"low": 3.0, "medium": 2.5, "high": 2.0}
DAY = 86400


def features(ts: np.ndarray, periods: Sequence[int], low: float, span: float) -> np.ndarray:
    """Columns 1, t, t*t and a sine and cosine for each period; t runs from 0 to 1, seasons follow absolute time."""
    t = (ts - low) / max(span, 1)
    seasons = [f(2 * np.pi * ts / p) for p in periods for f in (np.sin, np.cos)]
    return np.stack([np.ones_like(t), t, t * t, *seasons], axis=1)


def detect_periods(ts: np.ndarray) -> tuple[int, int]:
    """Two seasons that suit the series' typical gap (the upper median); fixed values: the seasons and from which gap they hold."""
    gaps = np.sort(np.diff(np.sort(ts)))
    typical = gaps[len(gaps) // 2] if len(gaps) else 300
    if typical >= DAY:
        return 7 * DAY, 365 * DAY
    if typical >= 3600:
        return DAY, 7 * DAY
    return DAY, DAY // 2


def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by the normal equations."""
    return np.linalg.solve(x.T @ x, x.T @ y)


def _fit(ts: np.ndarray, y: np.ndarray, periods: Sequence[int] | None):
    periods = list(detect_periods(ts) if periods is None else periods)
    if len(ts) < 3 + 2 * len(periods):
        return None
    low, span = float(ts.min()), float(ts.max() - ts.min())
    try:
        b = solve(features(ts, periods, low, span), y)
    except np.linalg.LinAlgError:
        return None
    return lambda at: features(at, periods, low, span) @ b


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("bucket")
    return pdf["bucket"].to_numpy(np.float64), pdf["value"].to_numpy(np.float64)


def forecast(series: DataFrame, horizon: int, width: int | None = None, periods: Sequence[int] | None = None) -> DataFrame:
    """(metric, series_key, bucket, value) after the last bucket up to ``horizon`` seconds; series with too few points give none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, y = _rows(pdf)
        model = _fit(ts, y, periods)
        step = width or int(np.diff(ts).min(initial=np.inf) if len(ts) > 1 else 300)
        at = np.arange(ts.max() + step, ts.max() + horizon + 1, step) if model else np.zeros(0)
        return pd.DataFrame({"metric": pdf["metric"].iloc[0], "series_key": pdf["series_key"].iloc[0], "bucket": at.astype(np.int64), "value": np.round(model(at), 4) if len(at) else at})

    return series.select("metric", "series_key", "bucket", "value").groupBy("metric", "series_key").applyInPandas(run, "metric string, series_key string, bucket long, value double")


def expected(series: DataFrame, periods: Sequence[int] | None = None) -> DataFrame:
    """Buckets with the fitted value, rounded to four places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        ts, y = _rows(pdf)
        model = _fit(ts, y, periods)
        if not model:
            return pdf.iloc[:0].assign(expected=np.zeros(0))
        return pdf.assign(expected=np.round(model(ts), 4))

    return series.select("metric", "series_key", "bucket", "value").groupBy("metric", "series_key").applyInPandas(run, "metric string, series_key string, bucket long, value double, expected double")


def zscores(rows: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Rows (metric, series_key, bucket, value, expected) with score and anomaly: residuals against their population deviation."""
    residual = rows.withColumn("residual", F.col("value") - F.col("expected"))
    stats = residual.groupBy("metric", "series_key").agg(F.avg("residual").alias("__mean"), F.greatest(F.stddev_pop("residual"), F.lit(1e-10)).alias("__std"))
    limit = SENSITIVITY.get(sensitivity, 2.5)
    scored = residual.join(stats, ["metric", "series_key"]).withColumn("score", (F.col("residual") - F.col("__mean")) / F.col("__std"))
    return scored.withColumn("anomaly", F.abs("score") > limit).drop("__mean", "__std")


def anomalies(series: DataFrame, sensitivity: str = "medium", periods: Sequence[int] | None = None) -> DataFrame:
    return zscores(expected(series, periods), sensitivity)


def median_gap(series: DataFrame) -> DataFrame:
    """(metric, series_key, gap): upper median of the gaps between buckets; 300 for a single bucket."""
    gaps = series.withColumn("gap", F.expr("bucket - lag(bucket) over (partition by metric, series_key order by bucket)"))
    agg = gaps.groupBy("metric", "series_key").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    return agg.select("metric", "series_key", F.when(F.size("g") == 0, F.lit(300)).otherwise(F.get("g", F.expr("size(g) div 2").cast("int"))).cast("long").alias("gap"))
