"""Sinks: JSON lines, response envelopes, own metrics, backup."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that a response holds at most; larger results are written as files.
MOST_ROWS = 1_000_000


def bounded(result: DataFrame, most: int | None = None) -> list:
    """The rows of a result for one response; an error if there are too many."""
    most = MOST_ROWS if most is None else most
    rows = result.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: ask for less, or export to files")
    return rows


def vm_json_lines(points: DataFrame) -> DataFrame:
    """(line): one JSON object for each series, times in milliseconds (import reads seconds)."""
    grouped = points.groupBy("metric", "series_key").agg(F.any_value("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("p"))
    metric = F.map_concat(F.map_filter("labels", lambda k, _: k != "__name__"), F.create_map(F.lit("__name__"), F.col("metric")))
    return grouped.select(F.to_json(F.struct(metric.alias("metric"), F.transform("p", lambda x: x.value).alias("values"), F.transform("p", lambda x: x.ts * 1000).alias("timestamps"))).alias("line"))


def number_text(v: float) -> str:
    """Shortest text that reads back as the same number."""
    return repr(float(v))


def _series(rows: Sequence, keys: Sequence[str]) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def matrix(result: DataFrame, keys: Sequence[str] = ("metric", "series_key")) -> str:
    """Range response; the result is collected, so it should be one that a person looks at."""
    series = []
    for key, rows in sorted(_series(bounded(result.orderBy(*keys, "bucket")), keys).items(), key=str):
        series.append({"metric": _labels(keys, key, rows[0]), "values": [[r["bucket"], number_text(r["value"])] for r in rows]})
    return json.dumps({"status": "success", "data": {"resultType": "matrix", "result": series}})


def vector(result: DataFrame, at: int, keys: Sequence[str] = ("metric", "series_key")) -> str:
    """Instant response: the last value of each series; a single zero if there is none."""
    last = result.groupBy(*keys).agg(F.max("bucket").alias("bucket"), F.max_by("value", "bucket").alias("value"), *([F.any_value("labels").alias("labels")] if "labels" in result.columns else []))
    rows = bounded(last)
    series = [{"metric": _labels(keys, tuple(r[k] for k in keys), r), "value": [r["bucket"], number_text(r["value"])]} for r in sorted(rows, key=lambda r: str([r[k] for k in keys]))]
    return json.dumps({"status": "success", "data": {"resultType": "vector", "result": series or [{"metric": {}, "value": [at, "0"]}]}})


def _labels(keys: Sequence[str], key: tuple, row) -> Mapping:
    if "series_key" in keys:
        return {**(row["labels"] or {}), "__name__": row["metric"]}
    return {k: v for k, v in zip(keys, key, strict=True) if v is not None}


def native(result: DataFrame, shape: str, keys: Sequence[str] = ("metric", "series_key"), metric: str | None = None) -> str:
    """flat: {metric, series}, multi: {series}, grouped: {metric, groups}."""
    out = []
    for key, rows in sorted(_series(bounded(result.orderBy(*keys, "bucket")), keys).items(), key=str):
        data = [[r["bucket"], r["value"]] for r in rows]
        if shape == "grouped":
            out.append({"group": {k: v for k, v in zip(keys, key, strict=True) if v is not None}, "data": data})
        else:
            out.append(({"metric": rows[0]["metric"]} if shape == "multi" else {}) | {"labels": dict(rows[0]["labels"] or {}), "data": data})
    return json.dumps({"multi": {"series": out}, "flat": {"metric": metric, "series": out}, "grouped": {"metric": metric, "groups": out}}[shape])


def exposition(stats: Mapping[str, float], prefix: str = "tidemark") -> str:
    """Own numbers as exposition text."""
    return "".join(f"# TYPE {prefix}_{k} {'counter' if k.endswith('_total') else 'gauge'}\n{prefix}_{k} {number_text(v) if isinstance(v, float) else v}\n" for k, v in stats.items())


def backup(tables: Mapping[str, DataFrame], target: str) -> dict:
    """Writes every table below ``target`` and returns what was written."""
    rows = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        rows[name] = df.sparkSession.read.parquet(f"{target}/{name}").count()
    return {"path": target, "tables": rows}
