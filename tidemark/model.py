"""Data model: points, text points, and projections of relational tables onto them.

A point is (metric, labels, series_key, ts, value, seq): ts in unix seconds, seq the
order of arrival, which decides between equal times.  series_key is a canonical string
of the label map, since maps cannot be compared or joined on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())
POINTS = T.StructType([T.StructField("metric", T.StringType()), T.StructField("labels", LABELS), T.StructField("series_key", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("seq", T.LongType())])
TEXT_POINTS = T.StructType([T.StructField(f.name, T.StringType() if f.name == "value" else f.dataType) for f in POINTS])
DAILY = "metric string, series_key string, labels map<string,string>, bucket long, avg double, min double, max double, count long, sum double, last double"


def series_key(labels: Column) -> Column:
    """Canonical, lossless string of a label map; key order does not matter."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.coalesce(labels, F.create_map().cast(LABELS))))))


def labels_of(key: Column | str = "series_key") -> Column:
    """The label map of a canonical string.  Aggregates group by the string alone, so that they can hash, and get the map back afterwards."""
    return F.from_json(key, LABELS)


def label_map(**columns: Column) -> Column:
    """Map of the labels that are not null (an absent label is an absent key), in order of keys."""
    ordered = [(k, columns[k].cast("string")) for k in sorted(columns)]
    whole = F.create_map(*[x for k, c in ordered for x in (F.lit(k), c)])
    # Only rows with an absent label take the slower way.
    every = reduce(lambda a, b: a & b, [c.isNotNull() for _, c in ordered])
    return F.when(every, whole).otherwise(F.map_filter(whole, lambda _, v: v.isNotNull()))


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp, rounded down."""
    return F.unix_timestamp(ts.cast("timestamp")).cast("long")


def points(df: DataFrame, metric: Column, labels: Column, ts: Column, value: Column, seq: Column, ordered: bool = False) -> DataFrame:
    """Numeric points; values that are no finite number are left out.  ``ordered``: the maps' keys are in order, as those of ``label_map``."""
    out = df.select(metric.cast("string").alias("metric"), labels.alias("labels"), ts.cast("long").alias("ts"), value.cast("double").alias("value"), seq.cast("long").alias("seq"))
    finite = F.abs("value") < float("inf")  # false for NaN, which is above infinity; the value is named once, since filters spell out what they name
    key = F.to_json("labels") if ordered else series_key(F.col("labels"))
    return out.where(finite).select("metric", "labels", key.alias("series_key"), "ts", "value", "seq")


def text_points(df: DataFrame, metric: Column, labels: Column, ts: Column, value: Column, seq: Column) -> DataFrame:
    out = df.select(metric.cast("string").alias("metric"), labels.alias("labels"), ts.cast("long").alias("ts"), value.cast("string").alias("value"), seq.cast("long").alias("seq"))
    return out.where("value is not null").select("metric", "labels", series_key(F.col("labels")).alias("series_key"), "ts", "value", "seq")


def from_events(events: DataFrame) -> DataFrame:
    """event_<type>{user} with the event's value."""
    c = F.col
    return points(events, F.concat(F.lit("event_"), c("event_type")), label_map(user=c("user_id")), seconds(c("ts")), c("value"), c("event_id"), ordered=True)


def events_text(events: DataFrame) -> DataFrame:
    """user_state{user}: the type of each event."""
    c = F.col
    return text_points(events, F.lit("user_state"), label_map(user=c("user_id")), seconds(c("ts")), c("event_type"), c("event_id"))


def from_orders(orders: DataFrame) -> DataFrame:
    """order_total{status, priority} with the order's total."""
    c = F.col
    return points(orders, F.lit("order_total"), label_map(status=c("o_orderstatus"), priority=c("o_orderpriority")), seconds(c("o_orderdate")), c("o_totalprice"), c("o_orderkey"), ordered=True)


def from_lineitem(items: DataFrame) -> DataFrame:
    """qty, price and discount {flag, status, supp}; every tenth supplier has no supp label."""
    c = F.col
    rows = items.select("*", F.expr("stack(3, 'qty', l_quantity, 'price', l_extendedprice, 'discount', l_discount) as (__metric, __value)"))
    supp = F.when(c("l_suppkey") % 10 != 0, c("l_suppkey"))
    return points(rows, c("__metric"), label_map(flag=c("l_returnflag"), status=c("l_linestatus"), supp=supp), seconds(c("l_shipdate")), c("__value"), c("l_orderkey") * 10 + c("l_linenumber"), ordered=True)
