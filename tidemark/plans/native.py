"""Range requests by parameters: which operators they call for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidemark.functions import transforms
from tidemark.functions.duration import duration_seconds, moment
from tidemark.functions.matchers import Matcher
from tidemark.operators import query as q
from tidemark.operators.aggregates import AGGREGATES, SERIES
from tidemark.plans import promql

RESERVED = ("metric", "metrics", "query", "start", "end", "from", "to", "step", "aggregate", "transform", "group_by", "cross_aggregate", "threshold_gt", "threshold_lt", "limit", "format")
DEFAULT_RANGE, DEFAULT_STEP = 3600, 60


def label_params(params: Mapping[str, str], regex: bool = True) -> dict[str, Matcher]:
    """Every parameter that is not reserved filters a label; values that begin with =~ are expressions."""
    return {k: Matcher("=~", v[2:]) if regex and v.startswith("=~") else Matcher("=", v) for k, v in params.items() if k not in RESERVED}


def aggregate_name(text: str | None) -> str:
    return text if text in AGGREGATES else "avg"


def cross_name(text: str | None) -> str | None:
    return text if text in ("max", "min", "sum", "avg", "count") else None


def time_range(params: Mapping[str, str], now: int) -> tuple[int, int]:
    """start beats from, end beats to."""
    return moment(params.get("start") or params.get("from"), now, now - DEFAULT_RANGE), moment(params.get("end") or params.get("to"), now, now)


def query_range(points: DataFrame, params: Mapping[str, str], now: int) -> tuple[DataFrame, str, list[str]]:
    """(result, shape, keys); shape is flat, multi or grouped.

    Several metrics, then groups, then a threshold decide the plan: a threshold does
    not count with several metrics or groups.  A limit keeps the top series of any shape.
    """
    start, end = time_range(params, now)
    step = duration_seconds(params.get("step") or str(DEFAULT_STEP))
    if params.get("query"):
        result, keys = promql.execute(points, params["query"], start, end, step)
        return result, "flat" if keys == list(SERIES) else "grouped", keys
    name, transform, labels = aggregate_name(params.get("aggregate")), transforms.parse(params.get("transform")), label_params(params)
    groups = [g.strip() for g in (params.get("group_by") or "").split(",") if g.strip()]
    several = [m.strip() for m in (params.get("metrics") or "").split(",") if m.strip()]
    metric = several or params.get("metric") or ""
    keys, shape = list(SERIES), "multi" if several else "flat"
    if groups:
        result = q.aggregate_grouped(points, metric, labels, groups, step, name, cross_name(params.get("cross_aggregate")), start, end, transform)
        keys, shape = groups, "grouped"
    else:
        result = q.aggregate_multi(points, metric, labels, step, name, start, end, transform)
        for op, key in ((">", "threshold_gt"), ("<", "threshold_lt")):
            if not several and params.get(key):
                result = q.threshold(result, op, float(params[key]))
                break
    if params.get("limit"):
        result = q.top_n(result, int(params["limit"]), keys=keys)
    return result, shape, keys
