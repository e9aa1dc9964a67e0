"""Registered queries of the metric engine, and their SQL twins.

Each query projects the relational tables onto points, runs the engine's operators and
returns flat scalar columns.  Floating-point results are rounded on both sides, since
sums depend on the order of rows in the last place.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import transforms as tf
from tidemark.functions.matchers import not_eq, not_regex, regex
from tidemark.operators import alerts, catalog, forecast, query, relabel, rollup, textseries
from tidemark.operators.aggregates import bucketed
from tidemark.plans import api, native, promql
from tidemark.session import ensure
from tidemark.sources import export, lines, scrape
from tidemark.store import Store
from tidemark.streaming import ingest, schedule

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: 2024-01-31T00:00:00Z, after all events.
NOW = 1706659200
WEEK1, WEEK2 = 1704672000, 1705276799
VIEW, DAY, HOUR = "event_view", 86400, 3600

P1 = "p AS (SELECT 'event_' || event_type AS metric, CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS seq FROM events)"
P5 = "p AS (SELECT 'order_total' AS metric, o_orderstatus AS status, o_orderpriority AS priority, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, o_totalprice AS value, o_orderkey AS seq FROM orders)"
P4 = """l AS (SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS supp,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, l_quantity, l_extendedprice, l_discount FROM lineitem),
p AS (SELECT 'qty' AS metric, flag, status, supp, ts, l_quantity AS value FROM l UNION ALL SELECT 'price', flag, status, supp, ts, l_extendedprice FROM l UNION ALL SELECT 'discount', flag, status, supp, ts, l_discount FROM l)"""


def _sql(text: str, **more: object) -> str:
    for k, v in {"P1": P1, "P4": P4, "P5": P5, "NOW": NOW, "WEEK1": WEEK1, "WEEK2": WEEK2, **more}.items():
        text = text.replace(f"${k}", str(v))
    return text


def registered(name: str, sql: str | None = None, **more: object) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ensure(spark), sf_dir)

        _QUERIES[name] = run
        if sql:
            _SQL[name] = _sql(sql, **more)
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return model.from_events(_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return model.from_orders(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return model.from_lineitem(_table(spark, d, "lineitem"))


def states(spark: SparkSession, d: str) -> DataFrame:
    return model.events_text(_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"))


def lab(*names: str) -> list:
    return [F.col("labels")[n].alias("usr" if n == "user" else n) for n in names]


def rnd(c: str = "value", n: int = 6):
    return F.round(c, n).alias(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = events(ensure(spark), sf_dir)
    hourly = query.aggregate_grouped(points, regex("event_(view|click)"), {}, ["user"], HOUR, "max", "max")
    return query.top_n(hourly, 10, keys=["user"]).select(F.col("user").alias("usr"), "bucket", "value")


registered(
    "flagship_top_users",
    """WITH $P1, s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, max(value) AS value FROM p WHERE metric IN ('event_view', 'event_click') GROUP BY ALL),
g AS (SELECT usr, bucket, max(value) AS value FROM s GROUP BY ALL), r AS (SELECT usr, arg_max(value, bucket) AS last FROM g GROUP BY usr ORDER BY last DESC, usr LIMIT 10)
SELECT usr, bucket, value FROM g WHERE usr IN (SELECT usr FROM r)""",
)(flagship)


@registered("raw_exact_q1", "WITH $P1 SELECT ts, value, seq FROM p WHERE metric = 'event_view' AND usr = '3'")
def _(spark, d):
    return query.raw(events(spark, d), VIEW, {"user": "3"}).select("ts", "value", "seq")


@registered("raw_multi_q2", "WITH $P1 SELECT usr, ts, value, seq FROM p WHERE metric = 'event_click' AND ts BETWEEN $WEEK1 AND $WEEK2")
def _(spark, d):
    return query.raw_multi(events(spark, d), "event_click", {}, WEEK1, WEEK2).select(*lab("user"), "ts", "value", "seq")


@registered("agg_exact_q3", "WITH $P1 SELECT (ts // 86400) * 86400 AS bucket, round(avg(value), 6) AS value FROM p WHERE metric = 'event_view' AND usr = '5' GROUP BY 1")
def _(spark, d):
    return query.aggregate(events(spark, d), VIEW, {"user": "5"}, "day", "avg").select("bucket", rnd())


@registered("agg_multi_q4", "WITH $P1 SELECT usr, (ts // 86400) * 86400 AS bucket, round(avg(value) / 10, 6) AS value FROM p WHERE metric = 'event_view' AND ts BETWEEN $WEEK1 AND $WEEK2 GROUP BY 1, 2")
def _(spark, d):
    return query.aggregate_multi(events(spark, d), VIEW, {}, (1, "days"), "avg", WEEK1, WEEK2, tf.divide(10)).select(*lab("user"), "bucket", rnd())


_PLAIN = {"avg_a1": "avg(value)", "min_a2": "min(value)", "max_a3": "max(value)", "sum_a4": "sum(value)", "count_a5": "CAST(count(value) AS BIGINT)"}
for _name, _agg in _PLAIN.items():

    @registered(f"agg_{_name}", "WITH $P1 SELECT usr, (ts // 21600) * 21600 AS bucket, $AGG AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2", AGG=_agg if "count" in _name else f"round({_agg}, 6)")
    def _(spark, d, name=_name.split("_")[0]):
        out = query.aggregate_multi(events(spark, d), VIEW, {}, (6, "hours"), name)
        return out.select(*lab("user"), "bucket", F.col("value") if name == "count" else rnd())


@registered(
    "agg_rate_a6",
    """WITH $P1, c AS (SELECT usr, ts, seq, sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY usr ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) % 500 AS value FROM p),
s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, CAST(value AS DOUBLE) - lag(CAST(value AS DOUBLE)) OVER w AS dv, ts - lag(ts) OVER w AS dt FROM c WINDOW w AS (PARTITION BY usr, ts // 86400 ORDER BY ts, seq DESC))
SELECT usr, bucket, round(coalesce(sum(CASE WHEN dv >= 0 AND dt > 0 THEN dv END) / sum(CASE WHEN dv >= 0 AND dt > 0 THEN dt END), 0), 9) AS value FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    rows = events(spark, d).withColumn("value", (F.expr("sum(cast(value as decimal(18,2))) over (partition by labels['user'] order by ts, seq rows unbounded preceding)") % 500).cast("double"))
    counter = model.points(rows, F.lit("event_total"), F.col("labels"), F.col("ts"), F.col("value"), F.col("seq"))
    return query.aggregate_multi(counter, "event_total", {}, "day", "rate").select(*lab("user"), "bucket", rnd(n=9))


for _name, _pick in {"last_a7": "arg_max(value, {'t': ts, 's': seq})", "first_a8": "arg_min(value, {'t': ts, 's': -seq})"}.items():

    @registered(f"agg_{_name}", "WITH $P5 SELECT status, priority, (ts // 604800) * 604800 AS bucket, $PICK AS value FROM p GROUP BY 1, 2, 3", PICK=_pick)
    def _(spark, d, name=_name.split("_")[0]):
        return query.aggregate_multi(orders(spark, d), "order_total", {}, "week", name).select(*lab("status", "priority"), "bucket", "value")


for _name, _width in {"minute": 60, "hour": HOUR, "day": DAY, "week": 7 * DAY}.items():

    @registered(f"bucket_{_name}_w2", "WITH $P1 SELECT usr, (ts // $N) * $N AS bucket, CAST(count(*) AS BIGINT) AS value FROM p WHERE metric = 'event_error' GROUP BY 1, 2", N=_width)
    def _(spark, d, name=_name):
        return query.aggregate_multi(events(spark, d), "event_error", {}, name, "count").select(*lab("user"), "bucket", "value")


_MATCH = {
    "filter_label_eq_f3": ({"status": "F"}, "status = 'F'"),
    "filter_label_re_f4": ({"priority": regex("[12]-.*")}, "regexp_full_match(priority, '[12]-.*')"),
    "filter_label_neq_f5": ({"status": not_eq("F")}, "(status IS NULL OR status <> 'F')"),
    "filter_label_nre_f5": ({"priority": not_regex("[12]-.*")}, "(priority IS NULL OR NOT regexp_full_match(priority, '[12]-.*'))"),
}
for _name, (_labels, _where) in _MATCH.items():

    @registered(_name, "WITH $P5 SELECT status, priority, ts, value FROM p WHERE $W", W=_where)
    def _(spark, d, labels=_labels):
        return query.raw_multi(orders(spark, d), "order_total", labels).select(*lab("status", "priority"), "ts", "value")


@registered("filter_absent_label_f5", "WITH $P4 SELECT metric, flag, supp, CAST(count(*) AS BIGINT) AS n FROM p WHERE metric = 'qty' AND (supp IS NULL OR supp <> '7') GROUP BY 1, 2, 3")
def _(spark, d):
    return query.select(items(spark, d), "qty", {"supp": not_eq("7")}).groupBy("metric", *lab("flag", "supp")).agg(F.count("*").alias("n"))


@registered("filter_absent_regex_f4", "WITH $P4 SELECT CAST(count(*) AS BIGINT) AS n FROM p WHERE metric = 'qty' AND supp IS NOT NULL")
def _(spark, d):
    return query.select(items(spark, d), "qty", {"supp": regex(".*")}).agg(F.count("*").alias("n"))


@registered("metric_regex_f2", "WITH $P1 SELECT metric, usr, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM p WHERE regexp_full_match(metric, 'event_(view|click)') GROUP BY 1, 2, 3")
def _(spark, d):
    return query.aggregate_multi(events(spark, d), regex("event_(view|click)"), {}, "day", "max").select("metric", *lab("user"), "bucket", "value")


@registered("time_range_f7", "WITH $P5 SELECT status, ts, value FROM p WHERE ts BETWEEN 820454400 AND 828316800")
def _(spark, d):
    return query.raw_multi(orders(spark, d), "order_total", {}, 820454400, 828316800).select(*lab("status"), "ts", "value")


@registered("multi_metric_q5", "WITH $P1 SELECT metric, usr, (ts // 86400) * 86400 AS bucket, round(sum(value), 6) AS value FROM p WHERE metric IN ('event_view', 'event_purchase') GROUP BY 1, 2, 3")
def _(spark, d):
    return query.aggregate_multi(events(spark, d), ["event_view", "event_purchase", "event_view"], {}, "day", "sum").select("metric", *lab("user"), "bucket", rnd())


for _cross in ("max", "avg", "count", "min", "sum"):

    @registered(
        f"grouped_{_cross}_q6",
        "WITH $P5, s AS (SELECT status, priority, (ts // 604800) * 604800 AS bucket, max(value) AS v FROM p GROUP BY 1, 2, 3) SELECT status, bucket, $AGG AS value FROM s GROUP BY 1, 2",
        AGG="CAST(count(v) AS DOUBLE)" if _cross == "count" else f"round({_cross}(v), 6)",
    )
    def _(spark, d, cross=_cross):
        return query.aggregate_grouped(orders(spark, d), "order_total", {}, ["status"], "week", "max", cross).select("status", "bucket", rnd())


@registered("grouped_two_keys_q6", "WITH $P4, s AS (SELECT flag, status, supp, (ts // 604800) * 604800 AS bucket, max(value) AS v FROM p WHERE metric = 'price' GROUP BY 1, 2, 3, 4) SELECT flag, status, bucket, round(sum(v), 2) AS value FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    return query.aggregate_grouped(items(spark, d), "price", {}, ["flag", "status"], "week", "max", "sum").select("flag", "status", "bucket", rnd(n=2))


@registered("grouped_missing_label_q6", "WITH $P4, s AS (SELECT flag, status, supp, (ts // 604800) * 604800 AS bucket, sum(value) AS v FROM p WHERE metric = 'qty' GROUP BY 1, 2, 3, 4) SELECT supp, bucket, round(max(v), 6) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    return query.aggregate_grouped(items(spark, d), "qty", {}, ["supp"], "week", "sum").select("supp", "bucket", rnd())


@registered("grouped_metrics_q7", "WITH $P1, s AS (SELECT metric, usr, (ts // 86400) * 86400 AS bucket, max(value) AS v FROM p WHERE metric IN ('event_view', 'event_click') GROUP BY 1, 2, 3) SELECT usr, bucket, round(sum(v), 6) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    return query.aggregate_grouped(events(spark, d), ["event_view", "event_click"], {}, ["user"], "day", "max", "sum").select(F.col("user").alias("usr"), "bucket", rnd())


@registered("grouped_by_name_q7", "WITH $P1, s AS (SELECT metric, usr, (ts // 86400) * 86400 AS bucket, max(value) AS v FROM p GROUP BY 1, 2, 3) SELECT metric AS name, bucket, max(v) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    return query.aggregate_grouped(events(spark, d), regex("event_.*"), {}, ["__name__"], "day", "max").select(F.col("__name__").alias("name"), "bucket", "value")


for _name, _op, _test in (("gt", ">", "max(value) OVER (PARTITION BY usr) > 150"), ("lt", "<", "min(value) OVER (PARTITION BY usr) < 1")):

    @registered(f"threshold_{_name}_f8", "WITH $P1, s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2) SELECT usr, bucket, value FROM s QUALIFY $TEST", TEST=_test)
    def _(spark, d, op=_op):
        out = query.aggregate_multi(events(spark, d), VIEW, {}, "day", "max")
        return query.threshold(out, op, 150.0 if op == ">" else 1.0).select(*lab("user"), "bucket", "value")


@registered(
    "top_n_q9",
    """WITH $P1, s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2),
r AS (SELECT usr, arg_max(value, bucket) AS last FROM s GROUP BY usr ORDER BY last DESC, '{"user":"' || usr || '"}' LIMIT 5) SELECT s.* FROM s WHERE usr IN (SELECT usr FROM r)""",
)
def _(spark, d):
    return query.top_n(query.aggregate_multi(events(spark, d), VIEW, {}, "day", "max"), 5).select(*lab("user"), "bucket", "value")


@registered("latest_exact_q10", "WITH $P1 SELECT max(ts) AS ts, arg_max(value, {'t': ts, 's': seq}) AS value FROM p WHERE metric = 'event_view' AND usr = '3'")
def _(spark, d):
    return query.latest_exact(events(spark, d), VIEW, {"user": "3"}).select("ts", "value")


@registered("latest_multi_q11", "WITH $P5 SELECT status, priority, max(ts) AS ts, arg_max(value, {'t': ts, 's': seq}) AS value FROM p GROUP BY 1, 2")
def _(spark, d):
    return query.latest(orders(spark, d), "order_total").select(*lab("status", "priority"), "ts", "value")


@registered("latest_asof_q12", "WITH $P5 SELECT status, priority, max(ts) AS ts, arg_max(value, {'t': ts, 's': seq}) AS value FROM p WHERE ts <= 852076800 GROUP BY 1, 2")
def _(spark, d):
    return query.latest(orders(spark, d), "order_total", at_most=852076800).select(*lab("status", "priority"), "ts", "value")


@registered("native_range_q16", "WITH $P1, s AS (SELECT usr, (ts // 3600) * 3600 AS bucket, sum(value) AS v FROM p WHERE metric = 'event_view' AND regexp_full_match(usr, '1.*') AND ts BETWEEN $NOW - 604800 AND $NOW GROUP BY 1, 2) SELECT usr, bucket, round(v * 2, 6) AS value FROM s")
def _(spark, d):
    result, _, _ = native.query_range(events(spark, d), {"metric": VIEW, "user": "=~1.*", "from": "-7d", "step": "1h", "aggregate": "sum", "transform": "multiply:2"}, NOW)
    return result.select(*lab("user"), "bucket", rnd())


@registered("native_limit_q16", "WITH $P5, s AS (SELECT status, priority, (ts // 2592000) * 2592000 AS bucket, max(value) AS v FROM p WHERE ts BETWEEN 788918400 AND 1000000000 GROUP BY 1, 2, 3), g AS (SELECT priority, bucket, min(v) AS value FROM s GROUP BY 1, 2), r AS (SELECT priority FROM g GROUP BY 1 ORDER BY arg_max(value, bucket) DESC, priority LIMIT 2) SELECT priority, bucket, value FROM g WHERE priority IN (SELECT priority FROM r)")
def _(spark, d):
    result, _, _ = native.query_range(orders(spark, d), {"metric": "order_total", "start": "788918400", "end": "1000000000", "step": "30d", "aggregate": "max", "group_by": "priority", "cross_aggregate": "min", "threshold_gt": "1e12", "limit": "2"}, NOW)
    return result.select("priority", "bucket", "value")


_TRANSFORMS = {"multiply_x1": ("multiply:8", "v * 8"), "divide_x2": ("divide:4", "v / 4"), "offset_x3": ("offset:-50", "v - 50"), "scale_x4": ("scale:1.8:32", "v * 1.8 + 32"), "log10_x5": ("log10", "CASE WHEN v > 0 THEN log10(v) ELSE 0 END")}
for _name, (_text, _expr) in _TRANSFORMS.items():

    @registered(f"transform_{_name}", "WITH $P1, s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, min(value) AS v FROM p WHERE metric = 'event_click' GROUP BY 1, 2) SELECT usr, bucket, round($E, 6) AS value FROM s", E=_expr)
    def _(spark, d, text=_text):
        return query.aggregate_multi(events(spark, d), "event_click", {}, "day", "min", transform=tf.parse(text)).select(*lab("user"), "bucket", rnd())


def _promql(spark, d, text, step=HOUR, start=WEEK1, end=WEEK2):
    out, keys = promql.execute(events(spark, d), text, start, end, step)
    names = [F.col(k).alias("usr" if k == "user" else "name" if k == "__name__" else k) for k in keys] if "labels" not in out.columns else ["metric", *lab("user")]
    return out.select(*names, "bucket", rnd())


_W = "WITH $P1, r AS (SELECT * FROM p WHERE ts BETWEEN $WEEK1 AND $WEEK2), "
_PROMQL = {
    "selector_l5": ('event_view{user="3"}', _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, avg(value) AS v FROM r WHERE metric = 'event_view' AND usr = '3' GROUP BY 1, 2, 3) SELECT metric, usr, bucket, round(v, 6) AS value FROM s"),
    "negative_l6": ("event_view{user!='3', user!~'1.*'}", _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, avg(value) AS v FROM r WHERE metric = 'event_view' AND NOT regexp_full_match(usr, '1.*') GROUP BY 1, 2, 3) SELECT metric, usr, bucket, round(v, 6) AS value FROM s"),
    "single_groupby_l8": ("max(max_over_time(event_view{user=~'1|2|3'}[1m])) by (user)", _W + "s AS (SELECT usr, (ts // 3600) * 3600 AS bucket, max(value) AS v FROM r WHERE metric = 'event_view' AND usr IN ('1', '2', '3') GROUP BY 1, 2) SELECT usr, bucket, round(v, 6) AS value FROM s"),
    "double_groupby_l8": ("avg(avg_over_time({__name__=~'event_(view|click)'}[1h])) by (__name__, user)", _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, avg(value) AS v FROM r WHERE metric IN ('event_view', 'event_click') GROUP BY 1, 2, 3) SELECT metric AS name, usr, bucket, round(v, 6) AS value FROM s"),
    "max_all_l8": ("max(max_over_time({__name__=~'event_.*', user=~'.*'}[1h])) by (__name__)", _W + "s AS (SELECT metric, (ts // 3600) * 3600 AS bucket, max(value) AS v FROM r GROUP BY 1, 2) SELECT metric AS name, bucket, round(v, 6) AS value FROM s"),
    "high_cpu_l1": ("max_over_time(event_view[1h]) > 150", _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, max(value) AS value FROM r WHERE metric = 'event_view' GROUP BY 1, 2, 3) SELECT metric, usr, bucket, round(value, 6) AS value FROM s QUALIFY max(value) OVER (PARTITION BY usr) > 150"),
    "outer_without_by_l3": ("sum(max_over_time(event_click[5m]))", _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, max(value) AS v FROM r WHERE metric = 'event_click' GROUP BY 1, 2, 3) SELECT metric, usr, bucket, round(v, 6) AS value FROM s"),
    "rate_l4": ("rate(event_view[5m])", _W + "s AS (SELECT metric, usr, (ts // 3600) * 3600 AS bucket, value - lag(value) OVER w AS dv, ts - lag(ts) OVER w AS dt FROM r WHERE metric = 'event_view' WINDOW w AS (PARTITION BY usr, ts // 3600 ORDER BY ts, seq DESC)) SELECT metric, usr, bucket, round(coalesce(sum(CASE WHEN dv >= 0 AND dt > 0 THEN dv END) / sum(CASE WHEN dv >= 0 AND dt > 0 THEN dt END), 0), 6) AS value FROM s GROUP BY 1, 2, 3"),
    "group_threshold_l8": ("max(max_over_time(event_view[1h])) by (user) < 5", _W + "s AS (SELECT usr, (ts // 3600) * 3600 AS bucket, max(value) AS value FROM r WHERE metric = 'event_view' GROUP BY 1, 2) SELECT usr, bucket, round(value, 6) AS value FROM s QUALIFY min(value) OVER (PARTITION BY usr) < 5"),
}
for _name, (_text, _twin) in _PROMQL.items():

    @registered(f"promql_{_name}", _twin)
    def _(spark, d, text=_text):
        return _promql(spark, d, text)


@registered("promql_instant_l10", "WITH $P1, s AS (SELECT usr, (ts // 300) * 300 AS bucket, max(value) AS v FROM p WHERE metric = 'event_view' AND ts BETWEEN 1705000100 - 300 AND 1705000100 GROUP BY 1, 2) SELECT usr, max(bucket) AS bucket, arg_max(v, bucket) AS value FROM s GROUP BY usr")
def _(spark, d):
    out, _ = promql.instant(events(spark, d), "max_over_time(event_view[5m])", 1705000100)
    return out.select(*lab("user"), "bucket", "value")


@registered("list_metrics_d1", "WITH $P1 SELECT DISTINCT metric FROM p")
def _(spark, d):
    return catalog.list_metrics(events(spark, d))


@registered("list_series_d2", "WITH $P5 SELECT DISTINCT metric, status, priority FROM p")
def _(spark, d):
    return catalog.list_series(orders(spark, d), "order_total").select("metric", *lab("status", "priority"))


@registered("label_values_d3", "WITH $P4 SELECT DISTINCT supp AS value FROM p WHERE metric = 'qty' AND supp IS NOT NULL")
def _(spark, d):
    return catalog.label_values(items(spark, d), "supp", "qty")


@registered("label_values_all_d4", "WITH $P1 SELECT DISTINCT usr AS value FROM p")
def _(spark, d):
    return catalog.label_values(events(spark, d), "user")


@registered("label_names_d5", "SELECT unnest(['__name__', 'flag', 'status', 'supp']) AS name")
def _(spark, d):
    return catalog.label_names(items(spark, d))


@registered("series_match_d6", "WITH $P4 SELECT DISTINCT metric, flag, status, supp FROM p WHERE metric = 'price' AND flag = 'R' AND (supp IS NULL OR NOT regexp_full_match(supp, '[1-5].*'))")
def _(spark, d):
    return catalog.match_series(items(spark, d), "price", {"flag": "R", "supp": not_regex("[1-5].*")}).select("metric", *lab("flag", "status", "supp"))


@registered("metadata_left_join_d7", "WITH $P1 SELECT metric, CASE WHEN metric = 'event_click' THEN 'counter' ELSE 'gauge' END AS metric_type, CASE WHEN metric = 'event_click' THEN 'clicks' END AS unit FROM (SELECT DISTINCT metric FROM p)")
def _(spark, d):
    known = catalog.register(spark.createDataFrame([], catalog.METADATA), "event_click", "counter", "clicks")
    return catalog.with_metadata(catalog.list_metrics(events(spark, d)), known).select("metric", "metric_type", "unit")


@registered("store_info_d8", "WITH $P5 SELECT CAST(count(DISTINCT status || '|' || priority) AS BIGINT) AS series_count, CAST(count(*) AS BIGINT) AS total_points, min(ts) AS oldest, max(ts) AS newest FROM p")
def _(spark, d):
    return catalog.store_info(orders(spark, d))


_NOTES = "(SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_type AS title, CASE WHEN value > 100 THEN ['big', event_type] ELSE [event_type] END AS tags FROM events)"


def _notes(spark, d):
    e = _table(spark, d, "events")
    tags = F.when(F.col("value") > 100, F.array(F.lit("big"), F.col("event_type"))).otherwise(F.array("event_type"))
    return e.select(F.col("event_id").alias("id"), model.seconds(F.col("ts")).alias("timestamp"), F.col("event_type").alias("title"), tags.alias("tags"))


@registered("annotations_range_f14", "SELECT id, timestamp, title FROM $NOTES WHERE timestamp BETWEEN $WEEK1 AND $WEEK2 AND list_has_any(tags, ['big', 'signup'])", NOTES=_NOTES)
def _(spark, d):
    return catalog.annotations(_notes(spark, d), WEEK1, WEEK2, ["big", "signup"]).select("id", "timestamp", "title")


@registered("annotated_points_j4", "WITH $P1, n AS (SELECT * FROM $NOTES WHERE list_contains(tags, 'big') AND title = 'error') SELECT p.seq, n.id FROM p JOIN n ON abs(p.ts - n.timestamp) <= 600 WHERE p.metric = 'event_view'", NOTES=_NOTES)
def _(spark, d):
    notes = _notes(spark, d).where("array_contains(tags, 'big') and title = 'error'")
    return catalog.annotate_points(query.select(events(spark, d), VIEW), notes, 600).select("seq", "id")


@registered("targets_left_join_j1", "SELECT s_suppkey AS id, s_name AS job_name, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal > 0 THEN 'up' ELSE 'down' END ELSE 'unknown' END AS health, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 0 END AS BIGINT) AS samples_scraped FROM supplier")
def _(spark, d):
    s = _table(spark, d, "supplier")
    health = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("target_id"), F.when(F.col("s_acctbal") > 0, "up").otherwise("down").alias("health"), F.col("s_suppkey").alias("samples_scraped"))
    return scrape.with_health(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("job_name")), health).select("id", "job_name", "health", "samples_scraped")


@registered("rules_states_join_j2", "SELECT n_nationkey AS id, CAST(count(c_custkey) AS BIGINT) AS n_states, min(CAST(c_custkey AS VARCHAR)) AS first_series FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    rules = _table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    held = _table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("rule_id"), F.col("c_custkey").cast("string").alias("series_key"), F.lit("firing").alias("state"), F.lit(0).cast("long").alias("triggered_at"))
    out = alerts.rules_with_states(rules, held)
    return out.select("id", F.size("states").cast("long").alias("n_states"), F.when(F.size("states") > 0, F.get("states", F.lit(0)).series_key).alias("first_series"))


_DAILY = "SELECT status, priority, (ts // 86400) * 86400 AS bucket, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max, CAST(count(*) AS BIGINT) AS count, round(sum(value), 4) AS sum, arg_max(value, {'t': ts, 's': -seq}) AS last FROM p"


def _daily(df):
    return df.select(*lab("status", "priority"), "bucket", rnd("avg", 4), "min", "max", "count", rnd("sum", 4), "last")


@registered("rollup_daily_r1", f"WITH $P5 {_DAILY} WHERE (ts // 86400) * 86400 < 915148800 GROUP BY 1, 2, 3")
def _(spark, d):
    return _daily(rollup.daily_rows(orders(spark, d), 0, 915148800 + 5000))


@registered("rollup_incremental_r3", f"WITH $P5, a AS ({_DAILY} WHERE (ts // 86400) * 86400 < 852076800 AND seq % 2 = 0 GROUP BY 1, 2, 3), b AS ({_DAILY} WHERE (ts // 86400) * 86400 > 851990400 AND (ts // 86400) * 86400 < 915148800 GROUP BY 1, 2, 3) SELECT * FROM a UNION ALL SELECT * FROM b")
def _(spark, d):
    # Half of the points arrive after their days were rolled: they stay out of the rollup.
    every = orders(spark, d)
    tier, mark = rollup.roll(every.where("seq % 2 = 0"), spark.createDataFrame([], model.DAILY), 0, 852076800)
    tier, _ = rollup.roll(every, tier, mark, 915148800)
    return _daily(tier)


@registered("query_daily_q15", f"WITH $P5 {_DAILY} WHERE status = 'F' AND priority = '1-URGENT' AND (ts // 86400) * 86400 BETWEEN 800000000 AND 900000000 GROUP BY 1, 2, 3")
def _(spark, d):
    tier = rollup.daily_rows(orders(spark, d), 0, NOW)
    return _daily(query.daily(tier, "order_total", {"status": "F", "priority": "1-URGENT"}, 800000000, 900000000))


@registered("retention_raw_r4", "WITH $P1 SELECT metric, usr, ts, value FROM p WHERE ts >= $NOW - 604800")
def _(spark, d):
    return rollup.retain(events(spark, d), NOW).select("metric", *lab("user"), "ts", "value")


@registered("retention_orphans_r4", "WITH $P1 SELECT metric, usr FROM p GROUP BY 1, 2 HAVING max(ts) < $NOW - 259200")
def _(spark, d):
    points = events(spark, d)
    return rollup.orphans(catalog.list_series(points), rollup.retain(points, NOW, 3 * DAY)).select("metric", *lab("user"))


@registered("ring_buffer_r5", "WITH $P1, b AS (SELECT *, (row_number() OVER (PARTITION BY metric, usr ORDER BY seq) - 1) // 5 AS blk, count(*) OVER (PARTITION BY metric, usr) // 5 AS full_blocks FROM p) SELECT metric, usr, ts, seq FROM b WHERE blk >= full_blocks - 3")
def _(spark, d):
    return rollup.ring_buffer(events(spark, d), 5, 3).select("metric", *lab("user"), "ts", "seq")


@registered("compact_r6", "WITH $P5 SELECT status, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM p GROUP BY 1")
def _(spark, d):
    # The rewritten layout answers like the points themselves.
    clustered = orders(spark, d).repartitionByRange(4, "metric", "series_key", "ts").sortWithinPartitions("metric", "series_key", "ts")
    return clustered.groupBy(*lab("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_PT = "p AS (SELECT CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS value, event_id AS seq FROM events)"


@registered("text_raw_q13", f"WITH {_PT} SELECT usr, ts, value FROM p WHERE usr IN ('1', '2')")
def _(spark, d):
    return query.raw_multi(states(spark, d), "user_state", {"user": regex("1|2")}).select(*lab("user"), "ts", "value")


@registered("text_latest_q13", f"WITH {_PT} SELECT usr, max(ts) AS ts, arg_max(value, {{'t': ts, 's': seq}}) AS value FROM p GROUP BY 1")
def _(spark, d):
    return query.latest(states(spark, d), "user_state").select(*lab("user"), "ts", "value")


for _name, _pick in {"last": "arg_max(value, {'t': ts, 's': seq})", "first": "arg_min(value, {'t': ts, 's': -seq})", "count": "CAST(count(*) AS BIGINT)"}.items():

    @registered(f"text_{_name}_q14", f"WITH {_PT} SELECT usr, (ts // 86400) * 86400 AS bucket, $PICK AS value FROM p GROUP BY 1, 2", PICK=_pick)
    def _(spark, d, name=_name):
        return query.text_aggregate(states(spark, d), "user_state", {}, "day", name).select(*lab("user"), "bucket", "value")


@registered("text_rle_c1", f"WITH {_PT}, c AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY usr ORDER BY ts, seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY usr ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT usr, min(ts) AS start_ts, value, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY usr, run, value")
def _(spark, d):
    return textseries.encode(states(spark, d)).select(*lab("user"), "start_ts", "value", F.size("timestamps").cast("long").alias("n"))


@registered("text_rle_round_trip_c1", f"WITH {_PT} SELECT usr, ts, value, seq FROM p")
def _(spark, d):
    return textseries.decode(textseries.encode(states(spark, d))).select(*lab("user"), "ts", "value", "seq")


_INGESTED = "WITH $P1 SELECT metric, usr, ts, value FROM p WHERE seq % 7 <> 0"


@registered("ingest_vmjson_s6", _INGESTED)
def _(spark, d):
    e = events(spark, d)
    body = e.select(F.when(F.col("seq") % 7 == 0, F.concat(F.lit('{"metric":{"__name__":"x"},"values":[1,2],"timestamps":['), "ts", F.lit("]}"))).otherwise(F.format_string('{"metric":{"__name__":"%s","user":"%s"},"values":[%s],"timestamps":[%s]}', "metric", F.col("labels")["user"], F.col("value").cast("string"), F.col("ts").cast("string"))).alias("line"), "seq")
    return lines.vm_json(body).points.select("metric", *lab("user"), "ts", "value")


@registered("ingest_prometheus_s7", _INGESTED)
def _(spark, d):
    e = events(spark, d)
    body = e.select(F.when(F.col("seq") % 7 == 0, F.concat("metric", F.lit(" NaN"))).otherwise(F.format_string('%s{user="%s"} %s %s', "metric", F.col("labels")["user"], F.col("value").cast("string"), (F.col("ts") * 1000).cast("string"))).alias("line"), "seq")
    return lines.prometheus(body, NOW).points.select("metric", *lab("user"), "ts", "value")


@registered("ingest_influx_s9", _INGESTED)
def _(spark, d):
    e = events(spark, d)
    body = e.select(F.when(F.col("seq") % 7 == 0, F.concat("metric", F.lit(' note="x" 1'))).otherwise(F.format_string("%s,user=%s value=%s,note=\"n\" %s", "metric", F.col("labels")["user"], F.col("value").cast("string"), (F.col("ts") * 1_000_000_000).cast("string"))).alias("line"), "seq")
    return lines.influx(body, NOW).points.select("metric", *lab("user"), "ts", "value")


@registered("ingest_errors_s10", "SELECT CAST(count(*) AS BIGINT) AS errors FROM events WHERE event_id % 7 = 0")
def _(spark, d):
    body = events(spark, d).select(F.when(F.col("seq") % 7 == 0, F.lit("not valid at all")).otherwise(F.concat("metric", F.lit(" 1 "), F.col("ts") * 1000)).alias("line"), "seq")
    return lines.prometheus(body, NOW).errors.agg(F.count("*").alias("errors"))


@registered("scrape_ts_s13", "SELECT l_orderkey AS k, CAST(CASE WHEN l_partkey % 3 = 0 THEN 1706659200 WHEN l_partkey % 3 = 1 THEN l_suppkey + 1700000000 ELSE l_suppkey + 1700000000 END AS BIGINT) AS ts FROM lineitem")
def _(spark, d):
    at = F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).when(F.col("l_partkey") % 3 == 1, F.col("l_suppkey") + 1700000000).otherwise((F.col("l_suppkey") + 1700000000) * 1000)
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), scrape.scrape_time(at, NOW).alias("ts"))


@registered("infer_type_s15", "SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 3 THEN 'counter' WHEN 4 THEN 'counter' ELSE 'gauge' END AS type, CASE p_partkey % 7 WHEN 0 THEN 'byte' WHEN 1 THEN 'second' WHEN 2 THEN 'millisecond' WHEN 5 THEN 'ratio' END AS unit FROM part")
def _(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, ("_bytes", "_seconds", "_milliseconds", "_total", "_count", "_ratio", "_x"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    kind, unit = catalog.infer_type("metric")
    return _table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("m"), suffix).alias("metric")).select("k", kind.alias("type"), unit.alias("unit"))


@registered("export_vmjson_k1", "WITH $P5 SELECT status, priority, CAST(count(*) AS BIGINT) AS n, min(ts) * 1000 AS first_ms, max(ts) * 1000 AS last_ms, round(sum(value), 2) AS total FROM p GROUP BY 1, 2")
def _(spark, d):
    parsed = export.vm_json_lines(orders(spark, d)).select(F.from_json("line", "metric map<string,string>, values array<double>, timestamps array<bigint>").alias("j"))
    v = F.col("j.values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return parsed.select(F.col("j.metric")["status"].alias("status"), F.col("j.metric")["priority"].alias("priority"), F.size(v).cast("long").alias("n"), F.array_min("j.timestamps").alias("first_ms"), F.array_max("j.timestamps").alias("last_ms"), F.round(total, 2).alias("total"))


def _tagged(spark, d):
    c = _table(spark, d, "customer")
    return c.select("c_custkey", model.label_map(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"), name=F.col("c_name")).alias("labels"))


_RELABEL = {
    "replace_b1": ([{"source_labels": ["segment", "nation"], "regex": "^(.)[^;]*;(\\d+)$", "target_label": "code", "replacement": "$1-$2"}], "code", "substr(c_mktsegment, 1, 1) || '-' || CAST(c_nationkey AS VARCHAR)", "true"),
    "keep_b2": ([{"action": "keep", "source_labels": ["segment"], "regex": "^BUILD"}], "segment", "c_mktsegment", "c_mktsegment LIKE 'BUILD%'"),
    "drop_b2": ([{"action": "drop", "source_labels": ["segment"], "regex": "^BUILD"}], "segment", "c_mktsegment", "c_mktsegment NOT LIKE 'BUILD%'"),
    "labeldrop_b3": ([{"action": "labeldrop", "regex": "^na"}], "name", "CAST(NULL AS VARCHAR)", "true"),
    "labelkeep_b3": ([{"action": "labelkeep", "regex": "seg"}], "segment", "c_mktsegment", "true"),
    "labelmap_b4": ([{"action": "labelmap", "regex": "^na(.*)$", "replacement": "my_$1"}], "my_tion", "CAST(c_nationkey AS VARCHAR)", "true"),
}
for _name, (_rules, _key, _expr, _where) in _RELABEL.items():

    @registered(f"relabel_{_name}", "SELECT c_custkey AS k, $E AS v, CAST($N AS BIGINT) AS n FROM customer WHERE $W", E=_expr, W=_where, N={"replace_b1": 4, "labeldrop_b3": 1, "labelkeep_b3": 1}.get(_name, 3))
    def _(spark, d, rules=_rules, key=_key):
        return relabel.apply(_tagged(spark, d), rules).select(F.col("c_custkey").alias("k"), F.col("labels")[key].alias("v"), F.size("labels").cast("long").alias("n"))


@registered("honor_labels_b6", "SELECT c_custkey AS k, 'target' AS segment, c_mktsegment AS exported_segment, 'i' AS instance FROM customer")
def _(spark, d):
    own = F.create_map(F.lit("segment"), F.lit("target"), F.lit("instance"), F.lit("i"))
    rows = _tagged(spark, d).withColumn("labels", relabel.honor_labels(F.col("labels"), own, False))
    return rows.select(F.col("c_custkey").alias("k"), *lab("segment", "exported_segment", "instance"))


@registered("median_interval_t2", "WITH $P1, s AS (SELECT DISTINCT usr, (ts // 3600) * 3600 AS bucket FROM p WHERE metric = 'event_view'), g AS (SELECT usr, bucket - lag(bucket) OVER (PARTITION BY usr ORDER BY bucket) AS gap FROM s), l AS (SELECT usr, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM g GROUP BY 1) SELECT usr, CAST(CASE WHEN g IS NULL OR len(g) = 0 THEN 300 ELSE g[len(g) // 2 + 1] END AS BIGINT) AS gap FROM l")
def _(spark, d):
    hourly = query.aggregate_multi(events(spark, d), VIEW, {}, "hour", "count")
    return forecast.median_gap(hourly).select(F.get_json_object("series_key", "$.user").alias("usr"), "gap")


@registered(
    "anomaly_zscore_t5",
    """WITH $P1, s AS (SELECT usr, (ts // 3600) * 3600 AS bucket, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2), e AS (SELECT *, round(avg(value) OVER (PARTITION BY usr), 2) AS expected FROM s),
z AS (SELECT *, (value - expected - avg(value - expected) OVER w) / greatest(stddev_pop(value - expected) OVER w, 1e-10) AS score FROM e WINDOW w AS (PARTITION BY usr)) SELECT usr, bucket, value, round(score, 4) AS score FROM z WHERE abs(score) > 2.5""",
)
def _(spark, d):
    hourly = query.aggregate_multi(events(spark, d), VIEW, {}, "hour", "max")
    mean = hourly.select("metric", "series_key", "bucket", "value", F.expr("round(avg(value) over (partition by metric, series_key), 2)").alias("expected"))
    out = forecast.zscores(mean, "medium").where("anomaly")
    return out.select(F.get_json_object("series_key", "$.user").alias("usr"), "bucket", "value", F.round("score", 4).alias("score"))


@registered("forecast_t4")
def _(spark, d):
    daily = bucketed(orders(spark, d), DAY, "avg")
    return forecast.forecast(daily, 7 * DAY, DAY).select(F.get_json_object("series_key", "$.status").alias("status"), F.get_json_object("series_key", "$.priority").alias("priority"), "bucket", "value")


@registered("anomalies_t6")
def _(spark, d):
    daily = bucketed(orders(spark, d), DAY, "avg")
    out = forecast.anomalies(daily, "medium").where("anomaly")
    return out.select(F.get_json_object("series_key", "$.status").alias("status"), F.get_json_object("series_key", "$.priority").alias("priority"), "bucket", "value", F.round("score", 2).alias("score"))


_RULE = alerts.Rule(1, "views", VIEW, "above", 30.0, 86400, "avg")


@registered("alert_value_e2", "WITH $P1, s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, avg(value) AS v FROM p WHERE metric = 'event_view' AND ts BETWEEN 1705276800 + 40000 - 86400 AND 1705276800 + 40000 GROUP BY 1, 2) SELECT usr, round(arg_max(v, bucket), 6) AS value FROM s GROUP BY 1")
def _(spark, d):
    out = alerts.rule_values(events(spark, d), [_RULE], 1705276800 + 40000)
    return out.select(F.get_json_object("series_key", "$.user").alias("usr"), rnd())


def _replayed(spark, d, duration):
    hourly = query.aggregate_multi(events(spark, d), VIEW, {}, "hour", "max")
    ticks = hourly.select(F.lit(1).cast("long").alias("rule_id"), "series_key", F.col("bucket").alias("tick"), "value", F.lit("above").alias("condition"), F.lit(60.0).alias("threshold"), F.lit(duration).cast("long").alias("duration"))
    return alerts.replay(ticks)


#: Without a duration the machine fires on every first breach and resolves on the next value below, so changes follow from neighbours alone.
@registered(
    "alert_history_e6",
    """WITH $P1, s AS (SELECT usr, (ts // 3600) * 3600 AS tick, max(value) > 60 AS hit, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2),
c AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY usr ORDER BY tick), false) AS before FROM s) SELECT usr, CASE WHEN hit THEN 'fire' ELSE 'resolve' END AS event, tick AS triggered_at, value FROM c WHERE hit <> before""",
)
def _(spark, d):
    return alerts.history(_replayed(spark, d, 0)).select(F.get_json_object("series_key", "$.user").alias("usr"), "event", "triggered_at", "value")


@registered(
    "alert_replay_e4",
    """WITH RECURSIVE $P1, s AS (SELECT usr, (ts // 3600) * 3600 AS tick, max(value) > 60 AS hit FROM p WHERE metric = 'event_view' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY tick) AS i FROM s),
m AS (SELECT DISTINCT usr, CAST(0 AS BIGINT) AS i, 'ok' AS state, CAST(NULL AS BIGINT) AS since FROM n
UNION ALL SELECT n.usr, n.i,
CASE WHEN n.hit AND m.state IN ('ok', 'resolved') THEN 'pending' WHEN n.hit AND m.state = 'pending' THEN CASE WHEN n.tick - m.since >= 7200 THEN 'firing' ELSE 'pending' END WHEN n.hit THEN 'firing' WHEN m.state = 'firing' THEN 'resolved' ELSE 'ok' END,
CASE WHEN NOT n.hit AND m.state <> 'firing' THEN NULL WHEN m.state = 'ok' THEN n.tick ELSE m.since END
FROM m JOIN n ON n.usr = m.usr AND n.i = m.i + 1)
SELECT usr, arg_max(state, i) AS state, max_by(coalesce(since, -1), i) AS triggered_at FROM m GROUP BY usr""",
)
def _(spark, d):
    return _replayed(spark, d, 7200).select(F.get_json_object("series_key", "$.user").alias("usr"), "state", F.coalesce("triggered_at", F.lit(-1).cast("long")).alias("triggered_at"))


# -- writes, small tables, responses: what an application sees of the operators


def _scratch(spark: SparkSession) -> str:
    """A new folder where the cluster shares files; of the driver only where there is no cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


@registered("store_append_s2", "WITH $P5 SELECT status, priority, ts, value, seq FROM p")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    store.append(orders(spark, d))
    return store.points().select(*lab("status", "priority"), "ts", "value", "seq")


@registered("store_days_s2", "WITH $P5 SELECT status, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p WHERE ts BETWEEN 820454400 AND 828316800 GROUP BY 1")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    store.append(orders(spark, d))
    return store.between(820454400, 828316800).groupBy(*lab("status")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@registered("store_write_s1", "SELECT metric, host, CAST(ts AS BIGINT) AS ts, CAST(value AS DOUBLE) AS value, CAST(place AS BIGINT) AS place FROM (VALUES ('m', 'a', 100, 7.0, 0), ('m', 'a', 100, 5.0, 1), ('m', 'b', 1706659200, 1.5, 2)) AS t(metric, host, ts, value, place)")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    for host, value, ts in (("a", 7.0, 100), ("a", 5.0, 100), ("b", 1.5, None)):
        store.write("m", {"host": host}, value, NOW, ts)
    place = (F.expr("row_number() over (order by seq)") - 1).cast("long")  # of three rows
    return store.points().select("metric", *lab("host"), "ts", "value", place.alias("place"))


@registered("store_text_s5", f"WITH {_PT} SELECT usr, value, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    store.append(states(spark, d), "text_points")
    return store.text().groupBy(*lab("user"), "value").agg(F.count("*").alias("n"))


@registered("store_rollup_r1", f"WITH $P5 {_DAILY} WHERE (ts // 86400) * 86400 < 915148800 GROUP BY 1, 2, 3")
def _(spark, d):
    # The second run, with the old watermark, adds nothing.
    store = Store(spark, _scratch(spark))
    store.append(orders(spark, d))
    for _ in range(2):
        store.rollup(0, 915148800 + 5000)
    return _daily(store.daily())


@registered("stream_append_v1", "WITH $P1 SELECT metric, usr, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM p GROUP BY 1, 2")
def _(spark, d):
    source = _table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parq*")
    at = _scratch(spark)
    ingest.append(stream, f"{at}/points", f"{at}/checkpoint", model.from_events).awaitTermination()
    rows = spark.read.schema(model.POINTS).parquet(f"{at}/points")
    return rows.groupBy("metric", *lab("user")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registered("live_buckets_v3", "WITH $P1 SELECT metric, usr, (ts // 86400) * 86400 AS bucket, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, CAST(count(*) AS BIGINT) AS count FROM p GROUP BY 1, 2, 3")
def _(spark, d):
    source = _table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    stream = model.from_events(spark.readStream.schema(source.schema).parquet(f"{d}/events.parq*"))
    at, kept = _scratch(spark), []
    out = ingest.live_buckets(stream, DAY, lateness=40 * DAY)
    write = lambda batch, _: (batch.write.mode("overwrite").parquet(f"{at}/live"), kept.append(1))
    out.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/live")
    return rows.select("metric", F.get_json_object("series_key", "$.user").alias("usr"), "bucket", "min", "max", rnd("sum", 4), "count")


@registered("backup_k6", "SELECT 'points' AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'text', CAST(count(*) AS BIGINT) FROM events")
def _(spark, d):
    done = export.backup({"points": orders(spark, d), "text": states(spark, d)}, _scratch(spark))
    return spark.createDataFrame(list(done["tables"].items()), "name string, n long")


_DAYS5 = "WITH $P5, s AS (SELECT status, priority, (ts // 2592000) * 2592000 AS bucket, max(value) AS value FROM p WHERE ts BETWEEN 820454400 AND 852076800 GROUP BY 1, 2, 3)"


def _months(spark, d):
    return query.aggregate_multi(orders(spark, d), "order_total", {}, 2592000, "max", 820454400, 852076800)


@registered("matrix_k2", f"{_DAYS5} SELECT status, priority, bucket, value FROM s")
def _(spark, d):
    sent = json.loads(export.matrix(_months(spark, d)))["data"]["result"]
    return spark.createDataFrame([(s["metric"]["status"], s["metric"]["priority"], t, float(v)) for s in sent for t, v in s["values"]], "status string, priority string, bucket long, value double")


@registered("vector_k3", f"{_DAYS5} SELECT status, priority, max(bucket) AS bucket, arg_max(value, bucket) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    sent = json.loads(export.vector(_months(spark, d), 0))["data"]["result"]
    return spark.createDataFrame([(s["metric"]["status"], s["metric"]["priority"], s["value"][0], float(s["value"][1])) for s in sent], "status string, priority string, bucket long, value double")


@registered("native_json_k4", f"{_DAYS5} SELECT status, bucket, max(value) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    result = query.aggregate_grouped(orders(spark, d), "order_total", {}, ["status"], 2592000, "max", "max", 820454400, 852076800)
    sent = json.loads(export.native(result, "grouped", ["status"], "order_total"))["groups"]
    return spark.createDataFrame([(g["group"]["status"], t, v) for g in sent for t, v in g["data"]], "status string, bucket long, value double")


@registered("exposition_k8", "SELECT 'total_points' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders")
def _(spark, d):
    text = export.exposition({"total_points": catalog.store_info(orders(spark, d)).first()["total_points"]})
    parsed = lines.prometheus(lines.from_text(spark, text), NOW).points
    return parsed.select(F.regexp_replace("metric", "^tidemark_", "").alias("name"), "value")


@registered("api_health_d9", "WITH $P5 SELECT CAST(count(DISTINCT status || '|' || priority) AS BIGINT) AS series, CAST(count(*) AS BIGINT) AS points FROM p")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    store.append(orders(spark, d))
    sent = json.loads(api.Api(store, lambda: NOW).handle("GET", "/health")[2])
    return spark.createDataFrame([(sent["series"], sent["points"])], "series long, points long")


@registered("self_monitor_s16", "SELECT 'tidemark_points_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'tidemark_points_per_second', count(*) / 10.0 FROM orders")
def _(spark, d):
    store = Store(spark, _scratch(spark))
    store.append(orders(spark, d))
    own = {k: v for k, v in schedule.store_counters(store).items() if k == "points"}
    return schedule.own_statistics(spark, NOW, own, {"points": 0.0}, 10.0).select("metric", "value")


@registered("payloads_k7", "SELECT n_nationkey AS rule_id, 'http://x/' || n_nationkey AS url, n_name AS alert, 'resolved' AS state, 'above' AS condition FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    nations = _table(spark, d, "nation").collect()
    rules = [alerts.Rule(n["n_nationkey"], n["n_name"], "m", "above", 1.0, webhook_url=f"http://x/{n['n_nationkey']}" if n["n_nationkey"] % 2 == 0 else None) for n in nations]
    happened = _table(spark, d, "nation").select(F.col("n_nationkey").alias("rule_id"), F.lit("{}").alias("series_key"), F.lit("resolve").alias("event"), F.lit(NOW).cast("long").alias("triggered_at"), F.lit(0.5).alias("value"))
    sent = alerts.payloads(happened, rules)
    field = lambda k: F.get_json_object("body", f"$.{k}").alias(k)
    return sent.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("rule_id"), "url", field("alert"), field("state"), field("condition"))


# -- filters and requests


@registered("threshold_text_f9", "WITH $P1, s AS (SELECT usr, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2) SELECT usr, bucket, value FROM s QUALIFY min(value) OVER (PARTITION BY usr) < 2.5")
def _(spark, d):
    return query.threshold(query.aggregate_multi(events(spark, d), VIEW, {}, "day", "max"), *tf.parse_threshold("filter_lt:2.5")).select(*lab("user"), "bucket", "value")


@registered("precedence_f10", "WITH $P1, s AS (SELECT metric, usr, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM p WHERE metric IN ('event_view', 'event_click') AND ts BETWEEN $WEEK1 AND $WEEK2 GROUP BY 1, 2, 3) SELECT metric, usr, bucket, value FROM s")
def _(spark, d):
    # With several metrics a threshold does not count.
    out, _, _ = native.query_range(events(spark, d), {"metrics": "event_view,event_click", "start": str(WEEK1), "end": str(WEEK2), "step": "1d", "aggregate": "max", "threshold_gt": "1e9"}, NOW)
    return out.select("metric", *lab("user"), "bucket", "value")


@registered("precedence_group_f10", _W + "s AS (SELECT metric, (ts // 86400) * 86400 AS bucket, max(value) AS value FROM r WHERE metric IN ('event_view', 'event_click') GROUP BY 1, 2) SELECT metric AS name, bucket, value FROM s")
def _(spark, d):
    # Groups of a pattern of metrics are not filtered.
    out, _ = promql.execute(events(spark, d), "max(max_over_time({__name__=~'event_(view|click)'}[1h])) by (__name__) > 1000000", WEEK1, WEEK2, DAY)
    return out.select(F.col("__name__").alias("name"), "bucket", "value")


@registered("label_params_f11", "WITH $P5 SELECT status, priority, (ts // 604800) * 604800 AS bucket, CAST(count(*) AS DOUBLE) AS value FROM p WHERE status = 'F' AND regexp_full_match(priority, '[12].*') AND ts BETWEEN 820454400 AND 852076800 GROUP BY 1, 2, 3")
def _(spark, d):
    out, _, _ = native.query_range(orders(spark, d), {"metric": "order_total", "status": "F", "priority": "=~[12].*", "from": "820454400", "to": "852076800", "step": "1w", "aggregate": "count"}, NOW)
    return out.select(*lab("status", "priority"), "bucket", F.col("value").cast("double").alias("value"))


@registered("relative_time_f12", "WITH $P1 SELECT usr, ts, value FROM p WHERE metric = 'event_view' AND ts BETWEEN $NOW - 259200 AND $NOW - 86400")
def _(spark, d):
    start, end = native.time_range({"start": "-3d", "end": "-24h"}, NOW)
    return query.raw_multi(events(spark, d), VIEW, {}, start, end).select(*lab("user"), "ts", "value")


@registered("aggregate_names_q17", "WITH $P5, s AS (SELECT status, priority, (ts // 604800) * 604800 AS bucket, avg(value) AS v FROM p WHERE ts BETWEEN 820454400 AND 852076800 GROUP BY 1, 2, 3) SELECT status, bucket, round(max(v), 6) AS value FROM s GROUP BY 1, 2")
def _(spark, d):
    # Unknown names: the average inside series, the maximum across them.
    out, _, _ = native.query_range(orders(spark, d), {"metric": "order_total", "start": "820454400", "end": "852076800", "step": "1w", "aggregate": "median", "group_by": "status", "cross_aggregate": "mode"}, NOW)
    return out.select("status", "bucket", rnd())


@registered("promql_name_l7", _W + "s AS (SELECT usr, (ts // 3600) * 3600 AS bucket, avg(value) AS v FROM r WHERE metric = 'event_view' AND usr = '3' GROUP BY 1, 2) SELECT usr, bucket, round(v, 6) AS value FROM s")
def _(spark, d):
    return _promql(spark, d, "{__name__=\"event_view\", user='3'}").drop("metric")


@registered("promql_unreadable_l9", "SELECT event_type AS usr, event_id AS bucket, value FROM events WHERE false")
def _(spark, d):
    # What is no query names a metric that isn't there; only an empty text is an error.
    return _promql(spark, d, "event_view >= 5").drop("metric")


@registered("text_split_f13", "SELECT CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS value FROM events WHERE event_id % 3 = 0")
def _(spark, d):
    e = _table(spark, d, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("value").cast("string"))
    body = e.select(F.format_string('{"metric":{"__name__":"m","user":"%s"},"values":[%s],"timestamps":[%s]}', F.col("user_id"), value, model.seconds(F.col("ts")).cast("string")).alias("line"), F.col("event_id").alias("seq"))
    return lines.vm_json(body).text.select(*lab("user"), "ts", "value")


@registered("list_of_values_s6", "WITH $P5, s AS (SELECT status, ts, value, row_number() OVER (PARTITION BY status ORDER BY seq) AS i FROM p) SELECT status, ts, value FROM s")
def _(spark, d):
    # All values of a series in one line.
    every = export.vm_json_lines(orders(spark, d).withColumn("series_key", F.to_json(F.create_map(F.lit("status"), F.col("labels")["status"]))))
    seconds = F.regexp_replace("line", r"([0-9]{9,10})000(?=[,\]])", "$1")
    return lines.vm_json(lines.numbered(every.select(seconds.alias("line")))).points.select(*lab("status"), "ts", "value")


# -- control tables


def _happened(spark, d):
    return alerts.history(_replayed(spark, d, 0)).withColumn("acknowledged", F.col("value") > 60)


_HISTORY = """WITH $P1, s AS (SELECT usr, (ts // 3600) * 3600 AS tick, max(value) > 60 AS hit, max(value) AS value FROM p WHERE metric = 'event_view' GROUP BY 1, 2),
c AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY usr ORDER BY tick), false) AS before FROM s), h AS (SELECT usr, '{"user":"' || usr || '"}' AS k, CASE WHEN hit THEN 'fire' ELSE 'resolve' END AS event, tick AS triggered_at, value > 60 AS acknowledged FROM c WHERE hit <> before)"""


@registered("history_filters_f15", f"{_HISTORY} SELECT usr, event, triggered_at FROM h WHERE acknowledged ORDER BY triggered_at DESC, k LIMIT 1000000")
def _(spark, d):
    out = alerts.search_history(_happened(spark, d), 1, True, 1_000_000)
    return out.select(F.get_json_object("series_key", "$.user").alias("usr"), "event", "triggered_at")


@registered("history_limit_o3", f"{_HISTORY} SELECT usr, event, triggered_at FROM h ORDER BY triggered_at DESC, k LIMIT 50")
def _(spark, d):
    return alerts.search_history(_happened(spark, d)).select(F.get_json_object("series_key", "$.user").alias("usr"), "event", "triggered_at")


@registered("history_clear_e7", f"{_HISTORY} SELECT usr, event, triggered_at FROM h WHERE NOT (triggered_at < $NOW - 604800 AND acknowledged)")
def _(spark, d):
    return alerts.clear_history(_happened(spark, d), NOW).select(F.get_json_object("series_key", "$.user").alias("usr"), "event", "triggered_at")


@registered("acknowledge_e7", f"{_HISTORY} SELECT triggered_at, CAST(count(*) AS BIGINT) AS n, bool_or(acknowledged) AS some FROM (SELECT triggered_at, acknowledged OR triggered_at = (SELECT max(triggered_at) FROM h) AS acknowledged FROM h) GROUP BY 1")
def _(spark, d):
    rows = _happened(spark, d)
    newest = rows.agg(F.max("triggered_at")).first()[0]
    return alerts.acknowledge(rows, 1, newest or 0).groupBy("triggered_at").agg(F.count("*").alias("n"), F.bool_or("acknowledged").alias("some"))


@registered("frozen_state_e5", "WITH $P1, s AS (SELECT usr, avg(value) AS v FROM p WHERE metric = 'event_view' AND ts BETWEEN $NOW - 172800 AND $NOW AND (ts // 172800) * 172800 = (SELECT 0 + ($NOW // 172800) * 172800) GROUP BY 1), u AS (SELECT DISTINCT usr FROM p) SELECT usr, 'firing' AS state, CAST(5 AS BIGINT) AS triggered_at FROM u WHERE usr NOT IN (SELECT usr FROM p WHERE metric = 'event_view' AND ts BETWEEN $NOW - 172800 AND $NOW)")
def _(spark, d):
    # Series without data in the window keep firing, whatever the limit; the others resolve.
    points = events(spark, d)
    held = points.select("series_key").distinct().select(F.lit(1).cast("long").alias("rule_id"), "series_key", F.lit("firing").alias("state"), F.lit(5).cast("long").alias("triggered_at"), F.lit(None).cast("long").alias("resolved_at"), F.lit(0.0).alias("value"))
    after, _ = alerts.evaluate(points, [alerts.Rule(1, "r", VIEW, "above", 1e9, 2 * DAY)], held, NOW)
    return after.where("state = 'firing'").select(F.get_json_object("series_key", "$.user").alias("usr"), "state", "triggered_at")


@registered("rule_crud_e1", """WITH s AS (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1), r AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey = 3 THEN 9.5 ELSE 1.0 END AS threshold, n_nationkey <> 4 AS enabled FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 25, 'new', 2.0, true)
SELECT CAST(id AS BIGINT) AS id, name, CAST(threshold AS DOUBLE) AS threshold, enabled, CASE WHEN id = 4 THEN 0 ELSE coalesce(n, 0) END AS n_states FROM r LEFT JOIN s ON k = id""")
def _(spark, d):
    kinds = [f"{x.strip()}" for x in alerts.RULES.replace("map<string,string>", "map").split(",")]
    given = {"id": F.col("n_nationkey"), "name": F.col("n_name"), "metric": F.lit("m"), "labels": F.create_map().cast("map<string,string>"), "aggregate": F.lit("avg"), "condition": F.lit("above"), "threshold": F.lit(1.0), "duration": F.lit(0).cast("long"), "enabled": F.lit(True), "webhook_url": F.lit(None).cast("string")}
    rules = _table(spark, d, "nation").select(*[given[k.split(" ")[0]].alias(k.split(" ")[0]) for k in kinds])
    held = _table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("rule_id"), F.col("c_custkey").cast("string").alias("series_key"), F.lit("firing").alias("state"), F.lit(0).cast("long").alias("triggered_at"))
    rules = alerts.create_rule(rules, alerts.Rule(0, "new", "m", "below", 2.0))
    rules, held = alerts.update_rule(rules, held, 3, threshold=9.5)
    rules, held = alerts.update_rule(rules, held, 4, enabled=False)
    rules, held = alerts.delete_rule(rules, held, 5)
    return alerts.rules_with_states(rules, held).select("id", "name", "threshold", "enabled", F.size("states").cast("long").alias("n_states"))


@registered("target_crud_s14", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 2 THEN 'changed' ELSE s_name END AS job_name, CAST(CASE WHEN s_suppkey = 2 THEN 30 ELSE 15 END AS BIGINT) AS scrape_interval, '/metrics' AS metrics_path FROM supplier WHERE s_suppkey <> 1 UNION ALL SELECT max(s_suppkey) + 1, 'added', 30, '/metrics' FROM supplier")
def _(spark, d):
    s = _table(spark, d, "supplier")
    own = [F.col("s_suppkey").alias("id"), F.col("s_name").alias("job_name"), F.lit("http").alias("scheme"), F.lit("a:1").alias("address"), F.lit("/metrics").alias("metrics_path"), F.lit(15).cast("long").alias("scrape_interval"), F.lit(10).cast("long").alias("scrape_timeout"), F.lit(False).alias("honor_labels"), F.lit(True).alias("honor_timestamps")]
    targets = scrape.update_target(scrape.add_target(s.select(*own), {"job_name": "added", "address": "x:1"}), 2, {"job_name": "changed", "address": "y:1"})
    targets, _ = scrape.delete_target(targets, spark.createDataFrame([], scrape.HEALTH), 1)
    return targets.select("id", "job_name", "scrape_interval", "metrics_path")


@registered("annotation_append_f14", "SELECT id, timestamp, title FROM $NOTES WHERE title = 'error' UNION ALL SELECT max(id) + 1, $NOW, 'deploy' FROM $NOTES", NOTES=_NOTES)
def _(spark, d):
    notes = _notes(spark, d).withColumn("description", F.lit(None).cast("string")).withColumn("created_at", F.lit(0).cast("long"))
    grown = catalog.add_annotation(notes, NOW, "deploy", tags=["ops"])
    return grown.where("title in ('error', 'deploy')").select("id", "timestamp", "title")


@registered("relabel_chain_b5", "SELECT c_custkey AS k, substr(c_mktsegment, 1, 1) || '-x' AS code FROM customer WHERE c_mktsegment NOT LIKE 'BUILD%'")
def _(spark, d):
    chain = [{"source_labels": ["segment"], "regex": "^(.).*$", "target_label": "code", "replacement": "$1"}, {"source_labels": ["segment"], "action": "drop", "regex": "^BUILD"}, {"source_labels": ["code"], "regex": "^(.*)$", "target_label": "code", "replacement": "$1-x"}, {"action": "labeldrop", "regex": "^na"}]
    return relabel.apply(_tagged(spark, d), chain).select(F.col("c_custkey").alias("k"), F.col("labels")["code"].alias("code"))


@registered("scraped_relabel_b7", "SELECT 'req' AS metric, 'own' AS job, CAST(n_nationkey AS VARCHAR) AS nation, CAST(n_nationkey AS DOUBLE) AS value FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    body = _table(spark, d, "nation").select(F.format_string('req{nation="%s",odd="%s"} %s', F.col("n_nationkey"), F.col("n_nationkey") % 2, F.col("n_nationkey")).alias("line"), F.col("n_nationkey").alias("seq"))
    got, _ = scrape.scraped(body, {"job_name": "own", "address": "a:1"}, NOW, 0.5, [{"action": "drop", "source_labels": ["odd"], "regex": "^1$"}])
    return got.where("metric = 'req'").select("metric", *lab("job", "nation"), "value")


# -- forecasts: without seasons the model is a parabola, whose three coefficients SQL finds by determinants

_PARABOLA = """WITH $P5, s AS (SELECT status, priority, (ts // 604800) * 604800 AS bucket, $AGG(value) AS y FROM p GROUP BY 1, 2, 3), e AS (SELECT status, priority, min(bucket) AS low, max(bucket) AS high, count(*) AS n FROM s GROUP BY 1, 2),
t AS (SELECT s.*, low, high, (bucket - low) / greatest(high - low, 1) AS t FROM s JOIN e USING (status, priority) WHERE n >= 3),
m AS (SELECT status, priority, any_value(low) AS low, any_value(high) AS high, CAST(count(*) AS DOUBLE) AS a, sum(t) AS b, sum(t*t) AS c, sum(t*t*t) AS d, sum(t*t*t*t) AS f, sum(y) AS u, sum(y*t) AS v, sum(y*t*t) AS w FROM t GROUP BY 1, 2),
k AS (SELECT *, a*(c*f-d*d) - b*(b*f-d*c) + c*(b*d-c*c) AS det FROM m),
q AS (SELECT status, priority, low, high, (u*(c*f-d*d) - b*(v*f-d*w) + c*(v*d-c*w)) / det AS k0, (a*(v*f-d*w) - u*(b*f-d*c) + c*(b*w-v*c)) / det AS k1, (a*(c*w-v*d) - b*(b*w-v*c) + u*(b*d-c*c)) / det AS k2 FROM k)"""


def _weekly(spark, d, name):
    return bucketed(orders(spark, d), 7 * DAY, name)


def _of_orders(*more):
    return [F.get_json_object("series_key", f"$.{k}").alias(k) for k in ("status", "priority")] + list(more)


@registered("forecast_trend_t4", _PARABOLA + ", h AS (SELECT *, unnest(range(high + 604800, high + 2419201, 604800)) AS bucket FROM q) SELECT status, priority, bucket, round(round(k0 + k1 * ((bucket - low) / (high - low)) + k2 * ((bucket - low) / (high - low)) * ((bucket - low) / (high - low)), 4), 2) AS value FROM h", AGG="avg")
def _(spark, d):
    out = forecast.forecast(_weekly(spark, d, "avg"), 28 * DAY, 7 * DAY, periods=())
    return out.select(*_of_orders("bucket", rnd(n=2)))


@registered("fit_trend_t3", _PARABOLA + " SELECT status, priority, bucket, round(round(k0 + k1 * t.t + k2 * t.t * t.t, 4), 2) AS expected FROM t JOIN q USING (status, priority)", AGG="sum")
def _(spark, d):
    out = forecast.expected(_weekly(spark, d, "sum"), periods=())
    return out.select(*_of_orders("bucket", rnd("expected", 2)))


@registered("anomalies_trend_t6", _PARABOLA + """, r AS (SELECT status, priority, bucket, y, y - round(k0 + k1 * t.t + k2 * t.t * t.t, 4) AS res FROM t JOIN q USING (status, priority)),
z AS (SELECT *, (res - avg(res) OVER g) / greatest(stddev_pop(res) OVER g, 1e-10) AS score FROM r WINDOW g AS (PARTITION BY status, priority)) SELECT status, priority, bucket, round(y, 2) AS value, round(score, 3) AS score FROM z WHERE abs(score) > 2.0""", AGG="sum")
def _(spark, d):
    out = forecast.anomalies(_weekly(spark, d, "sum"), "high", periods=()).where("anomaly")
    return out.select(*_of_orders("bucket", rnd(n=2), rnd("score", 3)))


@registered("features_t1", "WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events), r AS (SELECT min(ts) AS low, max(ts) AS high FROM e) SELECT event_id, round((ts - low) / (high - low), 8) AS t, round(sin(2 * pi() * ts / 86400), 6) AS s, round(cos(2 * pi() * ts / 86400), 6) AS c FROM e, r")
def _(spark, d):
    rows = _table(spark, d, "events").select("event_id", model.seconds(F.col("ts")).alias("ts"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()

    def run(batches):
        for pdf in batches:
            x = forecast.features(pdf["ts"].to_numpy("float64"), (DAY,), low, high - low)
            yield pdf[["event_id"]].assign(t=x[:, 1].round(8), s=x[:, 3].round(6), c=x[:, 4].round(6))

    return rows.mapInPandas(run, "event_id long, t double, s double, c double")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
