"""Semantics of the metric engine on small inputs with values worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import duration, transforms
from tidemark.functions.matchers import Matcher, not_eq, not_regex, regex
from tidemark.operators import alerts, catalog, chart, forecast, query, relabel, rollup, textseries
from tidemark.operators.aggregates import AGGREGATES, bucketed
from tidemark.plans import native, promql
from tidemark.sources import export, lines, scrape
from tidemark.store import Store
from tidemark.streaming import alerts as stream_alerts
from tidemark.streaming import ingest

BASE = 1_700_000_000


def points(spark, rows):
    """rows: (metric, labels, ts, value)."""
    df = spark.createDataFrame([(m, k, t, float(v), i) for i, (m, k, t, v) in enumerate(rows)], "metric string, labels map<string,string>, ts long, value double, seq long")
    c = F.col
    return model.points(df, c("metric"), c("labels"), c("ts"), c("value"), c("seq"))


def values(df, *keys):
    return sorted(tuple(r[k] for k in (*keys, "bucket", "value")) for r in df.collect())


@pytest.fixture(scope="module")
def cpu(spark):
    return points(spark, [(f"cpu_usage_{m}", {"hostname": f"host_{h}"}, BASE + 10 * i, 10 * h + (i * 7 + h) % 5) for m in ("user", "system") for h in range(10) for i in range(30)])


def test_negative_values_all_aggregates(spark):
    p = points(spark, [("t", {}, 7200 + i, v) for i, v in enumerate((-10, -20, -5, -30, -15))])
    got = {a: bucketed(p, 3600, a).first()["value"] for a in AGGREGATES if a != "rate"}
    assert got == {"avg": -16, "min": -30, "max": -5, "sum": -80, "count": 5, "last": -15, "first": -10}


def test_negative_times_cut_towards_zero(spark):
    p = points(spark, [("t", {}, -61, 1), ("t", {}, -1, 2), ("t", {}, 59, 3)])
    assert values(bucketed(p, 60, "count")) == [(-60, 1), (0, 2)]


def test_rate_inside_buckets(spark):
    grows = points(spark, [("c", {}, 300_000 + 60 * i, 100 * i) for i in range(6)])
    assert values(bucketed(grows, 300, "rate"))[0][1] == pytest.approx(100 / 60)
    reset = points(spark, [("c", {}, 360_000 + 60 * i, v) for i, v in enumerate((100, 200, 300, 50, 150, 250))])
    assert values(bucketed(reset, 360, "rate"))[0][1] == pytest.approx(400 / 240)
    assert values(bucketed(points(spark, [("c", {}, 0, 42.0)]), 60, "rate")) == [(0, 0.0)]


def test_equal_times(spark):
    p = points(spark, [("d", {}, 90000, 10), ("d", {}, 90000, 20)])
    assert p.count() == 2
    assert values(bucketed(p, 60, "last"))[0][1] == 20 and values(bucketed(p, 60, "first"))[0][1] == 20
    assert rollup.daily_rows(p, 0, 10 * 86400).first()["last"] == 10


def test_cross_series(spark):
    p = points(spark, [("disk", {"host": "a", "device": "sda"}, 60, 80), ("disk", {"host": "a", "device": "sdb"}, 61, 60), ("disk", {"host": "b", "device": "sda"}, 62, 40)])
    want = {"max": 80, "avg": 70, "sum": 140, "count": 2, "min": 60, None: 80}
    for how, v in want.items():
        out = dict((r["host"], r["value"]) for r in query.aggregate_grouped(p, "disk", {}, ["host"], 60, "avg", how).collect())
        assert out["a"] == v


def test_average_of_series_not_of_points(spark):
    p = points(spark, [("m", {"s": "1"}, 0, 10), ("m", {"s": "2"}, 1, 20), ("m", {"s": "2"}, 2, 40)])
    assert query.aggregate_grouped(p, "m", {}, [], 60, "avg", "avg").first()["value"] == 20


def test_absent_label_is_a_group_and_passes_negation(spark):
    p = points(spark, [("m", {"k": "a"}, 0, 1), ("m", {}, 0, 2)])
    assert {r["k"]: r["value"] for r in query.aggregate_grouped(p, "m", {}, ["k"], 60).collect()} == {"a": 1, None: 2}
    assert query.select(p, "m", {"k": not_eq("a")}).count() == 1
    assert query.select(p, "m", {"k": not_regex("a|b")}).count() == 1
    assert query.select(p, "m", {"k": regex(".*")}).count() == 1


def test_exact_and_subset_match(spark, cpu):
    p = points(spark, [("m", {"a": "1"}, 0, 1), ("m", {"a": "1", "b": "2"}, 5, 2), ("m", {"a": "x,y=z"}, 6, 3)])
    assert query.raw(p, "m", {"a": "1"}).count() == 1
    assert query.raw_multi(p, "m", {"a": "1"}).count() == 2
    assert query.raw(p, "m", {"a": "x,y=z"}).count() == 1
    assert query.select(cpu, "cpu_usage_user", {"hostname": regex("host_0|host_1|host_2")}).select("series_key").distinct().count() == 3


def test_range_is_closed_and_cuts_points_not_buckets(spark):
    p = points(spark, [("m", {}, t, t) for t in (0, 10, 20, 30, 70)])
    assert [r["ts"] for r in query.raw(p, "m", {}, 10, 30).collect()] == [10, 20, 30]
    assert values(query.aggregate(p, "m", {}, 60, "sum", 10, 30)) == [(0, 60)]


def test_threshold_keeps_whole_series(cpu):
    out = query.aggregate_multi(cpu, "cpu_usage_user", {}, 60, "max")
    hosts = lambda df: {r["labels"]["hostname"] for r in df.collect()}
    assert hosts(query.threshold(out, ">", 50)) == {f"host_{h}" for h in range(5, 10)}
    assert hosts(query.threshold(out, ">", 200)) == set()
    assert query.threshold(out, ">", 50).count() == 5 * out.count() // 10


def test_top_n_and_latest(cpu):
    out = query.top_n(query.aggregate_multi(cpu, "cpu_usage_user", {}, 60, "max"), 2)
    assert {r["labels"]["hostname"] for r in out.collect()} == {"host_8", "host_9"}
    assert query.latest(cpu, "cpu_usage_user").count() == 10
    assert query.latest(cpu, "cpu_usage_user", at_most=BASE).first()["ts"] == BASE


def test_transforms_and_specs():
    assert transforms.parse("nonsense") is None and transforms.parse("multiply:2") is not None
    assert transforms.parse_threshold("filter_gt:90") == (">", 90.0) and transforms.parse_threshold("x") is None
    with pytest.raises(ValueError):
        transforms.divide(0)
    assert [duration.bucket_seconds(x) for x in ("minute", "hour", "day", "week", (5, "minutes"), 7, "2h")] == [60, 3600, 86400, 604800, 300, 7, 7200]
    assert duration.moment("-1h", 10_000, 0) == 6400 and duration.moment("now", 5, 0) == 5 and duration.moment(None, 5, 3) == 3
    for bad in (0, True, "x"):
        with pytest.raises(ValueError):
            duration.bucket_seconds(bad)


def test_log_of_non_positive_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-5.0,), (1000.0,)], "v double")
    assert [r[0] for r in df.select(transforms.log10()(F.col("v"))).collect()] == [0.0, 0.0, pytest.approx(3.0)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("max(max_over_time(cpu{hostname=~'host_0|host_1'}[1m])) by (hostname)", promql.Grouped(promql.Windowed(promql.Selector("cpu", {"hostname": regex("host_0|host_1")}), "max_over_time", 60), "max", ("hostname",))),
        ("{__name__=~'cpu_.*', a=\"b\"}", promql.Windowed(promql.Selector(regex("cpu_.*"), {"a": Matcher("=", "b")}))),
        ("{__name__='x'}", promql.Windowed(promql.Selector("x", {}))),
        ("rate(x[5m]) > 1.5", promql.Passing(promql.Windowed(promql.Selector("x", {}), "rate", 300), ">", 1.5)),
        ("x >= 5", promql.Windowed(promql.Selector("x >= 5", {}))),
        ("avg(x)", promql.Windowed(promql.Selector("x", {}))),
        ("sum(x) by ()", promql.Windowed(promql.Selector("x", {}))),
        ("x{a='1,2', b=\"say \\\"hi\\\", {you}\"}", promql.Windowed(promql.Selector("x", {"a": Matcher("=", "1,2"), "b": Matcher("=", 'say "hi", {you}')}))),
        ("max(sum(x) by (a)) by (b)", promql.Windowed(promql.Selector("max(sum(x) by (a)) by (b)", {}))),
    ],
)
def test_promql_parser(text, want):
    assert promql.parse(text) == want


@pytest.mark.parametrize("text", ["", "  ", "{}", "{a='b'}", "{__name__!='x'}"])
def test_promql_errors(text):
    with pytest.raises(promql.PromQLError):
        promql.parse(text)


def test_promql_responses(spark, cpu):
    out, keys = promql.execute(cpu, "max(max_over_time(cpu_usage_user[1m])) by (hostname)", BASE, BASE + 300, 600)
    data = json.loads(export.matrix(out, keys))["data"]
    assert data["resultType"] == "matrix" and len(data["result"]) == 10 and data["result"][0]["values"][0][1] == "4.0"
    out, keys = promql.instant(cpu, "nothing", BASE)
    assert json.loads(export.vector(out, BASE, keys))["data"]["result"] == [{"metric": {}, "value": [BASE, "0"]}]
    flat, keys = promql.execute(cpu, "sum(cpu_usage_user)", BASE, BASE + 300, 600)
    assert len(json.loads(export.matrix(flat, keys))["data"]["result"]) == 10


def test_native_dispatch(cpu):
    now = BASE + 300
    run = lambda **p: native.query_range(cpu, {"start": str(BASE), "end": str(now), "step": "600", **p}, now)
    df, shape, _ = run(metric="cpu_usage_user", aggregate="max", threshold_gt="50")
    assert shape == "flat" and df.select("series_key").distinct().count() == 5
    df, shape, keys = run(metrics="cpu_usage_user,cpu_usage_system", threshold_gt="50")
    assert shape == "multi" and df.select("metric", "series_key").distinct().count() == 20
    df, shape, keys = run(metric="cpu_usage_user", group_by="hostname", limit="3")
    assert shape == "grouped" and df.select("hostname").distinct().count() == 3
    assert len(json.loads(export.native(df, shape, keys, "cpu_usage_user"))["groups"]) == 3
    assert run(metric="cpu_usage_user", hostname="=~host_[01]")[0].select("series_key").distinct().count() == 2


def test_vm_json(spark):
    body = '{"metric":{"__name__":"m","a":"x"},"values":[1,2.5,"on"],"timestamps":[10,20,30]}\nnot json\n{"metric":{"__name__":"m"},"values":[1],"timestamps":[1,2]}\n{"metric":{"b":"y"},"values":[7],"timestamps":[5]}\n{"metric":{"__name__":"m"},"values":[null],"timestamps":[1]}\n{"metric":{"__name__":"m"},"values":[1],"timestamps":[1.5]}\n'
    got = lines.vm_json(lines.from_text(spark, body))
    assert sorted((r["metric"], r["ts"], r["value"]) for r in got.points.collect()) == [("m", 10, 1.0), ("m", 20, 2.5), ("unknown", 5, 7.0)]
    assert [(r["value"], r["labels"]) for r in got.text.collect()] == [("on", {"a": "x"})]
    report = got.report()
    assert (report["samples"], report["errors"]) == (4, 4) and report["failed_lines"][0] == "not json"


def test_prometheus(spark):
    body = '# HELP x\nup{job="a",inst="h:1, \\"q\\""} 1 1700000000000\nplain 2.5\nzero 3 0\nbadts 4 x\nempty{} 1.0\ninf +Inf\nnan NaN\nhuge 1e999\nnot valid at all\nsuffix 1.5d\n'
    got = lines.prometheus(lines.from_text(spark, body), 99)
    assert sorted((r["metric"], r["ts"], r["value"]) for r in got.points.collect()) == [("badts", 99, 4.0), ("empty", 99, 1.0), ("plain", 99, 2.5), ("up", 1700000000, 1.0), ("zero", 99, 3.0)]
    assert {r["metric"]: r["labels"] for r in got.points.collect()}["up"] == {"job": "a", "inst": 'h:1, \\"q\\"'}
    assert got.errors.count() == 5


def test_influx(spark):
    body = 'cpu,host=a user=1.5,system=2i,note="x",ok=true 1700000000000000000\nmem value=7 1700000000000\n# c\nt value=3 1700000000\nu a=1\nbad\nstr s="x" 1\n'
    got = lines.influx(lines.from_text(spark, body), 42)
    assert sorted((r["metric"], r["ts"], r["value"]) for r in got.points.collect()) == [("cpu_system", 1700000000, 2.0), ("cpu_user", 1700000000, 1.5), ("mem", 1700000000, 7.0), ("t", 1700000000, 3.0), ("u_a", 42, 1.0)]
    assert got.errors.count() == 2


def test_influx_load(spark):
    body = "\n".join(f"cpu,hostname=host_{h},region=us usage_user={15 * h + i},usage_system={(15 * h + i) / 2} {(BASE + 60 * i) * 10**9}" for h in range(5) for i in range(10))
    got = lines.influx(lines.from_text(spark, body), 0)
    out, keys = promql.execute(got.points, "max(max_over_time(cpu_usage_user[1m])) by (hostname)", BASE, BASE + 600, 600)
    assert values(out, "hostname") == sorted((f"host_{h}", b, v) for h in range(5) for b, v in ((1699999800, 15 * h + 6), (1700000400, 15 * h + 9)))


def test_export_round_trip(spark):
    p = points(spark, [("m", {"a": "b"}, BASE + 60 * i, v) for i, v in enumerate((10, 20, 30))])
    line = json.loads(export.vm_json_lines(p).first()["line"])
    assert line == {"metric": {"a": "b", "__name__": "m"}, "values": [10.0, 20.0, 30.0], "timestamps": [(BASE + 60 * i) * 1000 for i in range(3)]}


def test_extreme_values(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    want = [1.7976931348623157e308, -1.7976931348623157e308, 5e-324, 1e-100, -1e-200, 0.0]
    store.write_batch([("x", {}, v, i) for i, v in enumerate(want)] + [("x", {}, float("inf"), 99), ("x", {}, float("nan"), 98)], now=7)
    assert [r["value"] for r in query.raw(store.points(), "x", {}).collect()] == want


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.points().count() == 0 and query.latest(store.points(), "x").count() == 0
    store.write("m", {"a": 1}, 2.0, now=200_000)
    store.write_batch([("m", {"a": 1}, 3.0, 100_000), ("state", {}, "running", 5)], now=200_000, first_seq=1)
    assert store.info().first()["total_points"] == 2
    assert query.latest(store.text(), "state").first()["value"] == "running"
    assert store.rollup(0, 300_000) == 172_800
    assert store.daily().count() == 2
    assert store.rollup(0, 300_000) == 172_800 and store.daily().count() == 2  # with the old watermark: nothing twice
    assert store.between(150_000, 250_000).count() == 1 and store.between(0, 90_000).count() == 0
    report = export.backup({"points": store.points()}, str(tmp_path / "copy"))
    assert report["tables"] == {"points": 2}


def test_files_of_the_store_follow_days_and_bytes(spark, tmp_path):
    def append(name, rows, key, value):
        store, before = Store(spark, str(tmp_path / name)), spark.conf.get(f"spark.sql.adaptive.{key}")
        spark.conf.set(f"spark.sql.adaptive.{key}", value)
        try:
            store.append(rows)
        finally:
            spark.conf.set(f"spark.sql.adaptive.{key}", before)
        return store, len(store.points().inputFiles())

    few = spark.range(1200).selectExpr("'m' as metric", "map('a', string(id % 15)) as labels", "string(id % 15) as series_key", "id * 2160 as ts", "double(id) as value", "id as seq").repartition(3)
    store, files = append("days", few, "coalescePartitions.enabled", "false")
    assert files == 30 and store.points().count() == 1200  # 30 days of 15 series: a file each
    assert store.rollup(5 * 86400, 9 * 86400 + 5) == 8 * 86400
    assert {r["bucket"] // 86400 for r in store.daily().collect()} == {6, 7, 8}
    day = few.withColumn("ts", F.col("seq"))
    large, files = append("large", day.unionByName(day), "advisoryPartitionSizeInBytes", "32k")
    assert files > 1 and large.points().count() == 2400  # a day larger than a task should read


def test_later_writes_win_at_equal_times(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for v in (5.0, 7.0, 6.0):
        store.write("m", {}, v, now=9, ts=100)
    again = Store(spark, store.path)
    again.write("m", {}, 2.0, now=9, ts=100)
    assert query.latest(again.points(), "m").first()["value"] == 2.0
    assert [r["value"] for r in query.raw(again.points(), "m", {}).collect()] == [5.0, 7.0, 6.0, 2.0]


def test_line_numbers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(100)))
    got = [r["line"] for r in lines.read(spark, str(tmp_path)).orderBy("seq").collect()]
    assert [int(x.split()[1]) for x in got if x.startswith("1 ")] == list(range(100))
    many = lines.numbered(spark.range(3000).repartition(1500).select(F.lit("m 1").alias("line")))
    assert many.select("seq").distinct().count() == 3000 and many.agg(F.min("seq")).first()[0] >= 0
    both = lines.vm_json(lines.from_text(spark, '{"metric":{"__name__":"m"},"values":[1,2,3],"timestamps":[5,5,5]}\n{"metric":{"__name__":"m"},"values":[4],"timestamps":[5]}')).points
    assert [r["value"] for r in both.orderBy("seq").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_rules_and_targets(spark):
    rules, states = spark.createDataFrame([], alerts.RULES), spark.createDataFrame([(1, "{}", "firing", 5, None, 1.0), (2, "{}", "pending", 5, None, 1.0)], alerts.STATES)
    for name in ("a", "b", "c"):
        rules = alerts.create_rule(rules, alerts.Rule(0, name, "m", "above", 3.0, labels={"x": regex("1.*"), "y": "2", "z": Matcher("!=", "3")}))
    assert [r.id for r in alerts.load_rules(rules)] == [1, 2, 3] and alerts.load_rules(rules)[0].labels == {"x": regex("1.*"), "y": "2", "z": Matcher("!=", "3")}
    rules, states = alerts.update_rule(rules, states, 1, threshold=9.0)
    assert states.count() == 2 and alerts.load_rules(rules)[0].threshold == 9.0
    rules, states = alerts.update_rule(rules, states, 1, enabled=False)
    assert [r["rule_id"] for r in states.collect()] == [2]
    rules, states = alerts.delete_rule(rules, states, 2)
    assert states.count() == 0 and [r.id for r in alerts.load_rules(rules)] == [1, 3]
    for bad in ({"id": 3}, {"condition": "near"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            alerts.update_rule(rules, states, 1, **bad)
    targets, health = spark.createDataFrame([], scrape.TARGETS), spark.createDataFrame([(1, "up", 5, 1, 3, None)], scrape.HEALTH)
    targets = scrape.add_target(scrape.add_target(targets, {"job_name": "j", "address": "a:1"}), {"job_name": "k", "address": "b:1", "scrape_interval": 5})
    targets = scrape.update_target(targets, 2, {"job_name": "k2", "address": "b:2"})
    assert [(r["id"], r["job_name"], r["scheme"], r["scrape_interval"]) for r in targets.orderBy("id").collect()] == [(1, "j", "http", 30), (2, "k2", "http", 30)]
    assert scrape.update_target(targets, 9, {"job_name": "x", "address": "y"}).count() == 2
    targets, health = scrape.delete_target(targets, health, 1)
    assert targets.count() == 1 and health.count() == 0
    for bad in ({"job_name": "j"}, {"job_name": "j", "address": "a", "scrape_interval": 0}, {"job_name": "j", "address": "a", "odd": 1}):
        with pytest.raises(ValueError):
            scrape.add_target(targets, bad)


def test_annotations_are_added(spark):
    table = spark.createDataFrame([], catalog.ANNOTATIONS)
    table = catalog.add_annotation(catalog.add_annotation(table, 5, "a", None, ["x"], 9), 6, "b")
    assert [(r["id"], r["title"], r["tags"]) for r in catalog.annotations(table, 0, 10).collect()] == [(1, "a", ["x"]), (2, "b", [])]
    with pytest.raises(ValueError):
        catalog.add_annotation(table, 5, "")


def test_time_ticks():
    assert chart.time_ticks(0, 3600) == list(range(0, 3601, 600)) and chart.time_ticks(0, 86400) == list(range(0, 86401, 14400))
    assert chart.time_ticks(0, 20 * 86400) == list(range(0, 20 * 86400 + 1, 4 * 86400)) and chart.time_ticks(5, 5) == []


def test_responses_have_a_limit(cpu, monkeypatch):
    monkeypatch.setattr(export, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        export.matrix(query.aggregate_multi(cpu, "cpu_usage_user", {}, 60, "max"))


def test_api_of_small_tables(spark, tmp_path):
    from tidemark.plans.api import Api

    api = Api(Store(spark, str(tmp_path / "api")), lambda: 1_700_001_000)
    call = lambda method, at, params=None, **sent: (r := api.handle(method, "/api/v1/" + at, params, json.dumps(sent) if sent else ""))[0] == 200 and json.loads(r[2])
    assert call("POST", "alerts", name="hot", metric="cpu", condition="above", threshold=5) == {"status": "created"}
    assert not call("POST", "alerts", name="hot") and not call("POST", "alerts", name="x", metric="m", condition="near", threshold=1)
    api.handle("POST", "/write", body="cpu,host=b value=9 1700000999\ncpu,host=a value=1 1700000999")
    assert call("POST", "alerts/evaluate", x=1)
    assert [(r["name"], [s["state"] for s in r["states"]]) for r in call("GET", "alerts")["data"]] == [("hot", ["firing"])]
    seen = call("GET", "alerts/history")["data"]
    assert [r["event"] for r in seen] == ["fire"]
    assert call("POST", "alerts/acknowledge", rule_id=1, triggered_at=seen[0]["triggered_at"]) and call("GET", "alerts/history", {"acknowledged": "false"})["data"] == []
    assert call("PUT", "alerts/1", enabled=False) and call("GET", "alerts/1")["data"][0]["states"] == []
    assert call("DELETE", "alerts/1") and call("GET", "alerts")["data"] == []
    assert call("POST", "scrape_targets", job_name="j", address="a:1") and call("PUT", "scrape_targets/1", job_name="k", address="a:1")
    assert [(r["job_name"], r["health"]) for r in call("GET", "scrape_targets")["data"]] == [("k", "unknown")]
    assert call("DELETE", "scrape_targets/1") and call("GET", "scrape_targets")["data"] == [] and not call("POST", "scrape_targets", job_name="j")
    assert call("POST", "annotations", title="deploy", tags=["x"], timestamp=1_700_000_500) and [r["title"] for r in call("GET", "annotations", {"tags": "x,y"})["data"]] == ["deploy"]
    assert call("DELETE", "annotations/1") and call("GET", "annotations")["data"] == []
    assert call("POST", "metadata", metric="cpu", type="counter", unit="s") and call("GET", "metadata", {"metric": "cpu"})["metric_type"] == "counter"
    assert call("GET", "metadata", {"metric": "other"})["metric_type"] == "gauge" and not call("POST", "metadata", metric="cpu", type="odd")
    assert call("POST", "backup", path=str(tmp_path / "copy"))["tables"]["points"] == 2


def test_stream_batches_that_run_again_replace_themselves(spark, tmp_path):
    p = points(spark, [("m", {}, i, i) for i in range(9)])
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.POINTS).parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    for f in (tmp_path / "cp" / "commits").iterdir():  # as if the stream had failed before it could note the batch
        f.unlink()
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_rollup_watermark_never_moves_back(spark):
    p = points(spark, [("m", {}, d * 86400 + 5, d) for d in range(4)])
    tier, mark = rollup.roll(p, spark.createDataFrame([], model.DAILY), 0, 3 * 86400 + 100)
    assert sorted(r["bucket"] // 86400 for r in tier.collect()) == [1, 2] and mark == 2 * 86400  # day 0 is never rolled
    late = p.unionByName(points(spark, [("m", {}, 86400 + 9, 77)]))
    tier, mark = rollup.roll(late, tier, mark, 4 * 86400 + 1)
    assert sorted((r["bucket"] // 86400, r["max"]) for r in tier.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert rollup.next_watermark(mark, 0) == mark


def test_ring_buffer(spark):
    p = points(spark, [("m", {}, i, i) for i in range(25)])
    assert sorted(r["value"] for r in rollup.ring_buffer(p, 5, 3).collect()) == list(range(10, 25))


def test_text_series(spark):
    df = spark.createDataFrame([("s", {"i": "1"}, t, v, i) for i, (t, v) in enumerate(((1, "a"), (2, "a"), (3, ""), (4, "é"), (5, "a")))], "metric string, labels map<string,string>, ts long, value string, seq long")
    c = F.col
    p = model.text_points(df, c("metric"), c("labels"), c("ts"), c("value"), c("seq"))
    runs = textseries.encode(p)
    assert sorted((r["start_ts"], r["value"]) for r in runs.collect()) == [(1, "a"), (3, ""), (4, "é"), (5, "a")]
    assert sorted(map(tuple, textseries.decode(runs).select("ts", "value").collect())) == sorted(map(tuple, p.select("ts", "value").collect()))
    with pytest.raises(ValueError):
        query.text_aggregate(p, "s", {}, 60, "avg")


def test_relabel(spark):
    df = spark.createDataFrame([({"__address__": "h:9", "job": "j", "__meta_x": "1"},), ({"job": "k"},)], "labels map<string,string>")
    run = lambda *rules: [r["labels"] for r in relabel.apply(df, rules).collect()]
    assert run({"source_labels": ["__address__"], "regex": "(.*):(.*)", "target_label": "host", "replacement": "$1"})[0]["host"] == "h"
    assert run({"source_labels": ["job"], "regex": "x", "target_label": "job", "replacement": "y"})[1] == {"job": "k"}
    assert run({"source_labels": ["job"], "regex": "k", "target_label": "z"})[1]["z"] == "$1"
    assert len(run({"action": "keep", "source_labels": ["job"], "regex": "j"})) == 1
    assert len(run({"action": "drop", "source_labels": ["job"], "regex": "j"})) == 1
    assert run({"action": "labelmap", "regex": "__meta_(.*)"})[0] == {"__address__": "h:9", "job": "j", "x": "1"}
    assert run({"action": "labeldrop", "regex": "^__"})[0] == {"job": "j"}
    with pytest.raises(ValueError):
        run({"action": "hashmod"})


def test_scrape(spark):
    with pytest.raises(ValueError):
        scrape.target({"job_name": "x"})
    with pytest.raises(ValueError):
        scrape.target({"job_name": "x", "address": "a", "scrape_interval": 0})
    body = lines.from_text(spark, 'req{job="own",code="200"} 5\n')
    got, errors = scrape.scraped(body, {"job_name": "j", "address": "h:1"}, now=1000, seconds=0.25, rules=[{"action": "labeldrop", "regex": "^code$"}])
    by = {r["metric"]: (dict(r["labels"]), r["ts"], r["value"]) for r in got.collect()}
    assert by["req"] == ({"job": "j", "instance": "h:1", "exported_job": "own"}, 1000, 5.0)
    assert by["up"][2] == 1.0 and by["scrape_samples_scraped"][2] == 1.0 and errors.count() == 0


def test_forecast(spark):
    p = points(spark, [("m", {"k": "a"}, BASE + 300 * i, 100 + 50 * np.sin(2 * np.pi * (BASE + 300 * i) / 86400)) for i in range(576)] + [("m", {"k": "few"}, BASE + 300 * i, 1) for i in range(5)])
    series = bucketed(p, 300, "avg")
    out = forecast.forecast(series, 3600, 300).toPandas()
    assert len(out) == 12 and out["value"].between(20, 180).all()
    fit = forecast.expected(series).toPandas()
    assert (fit["value"] - fit["expected"]).abs().mean() < 5
    x = forecast.features(np.arange(10) * 60.0, [86400], 0.0, 540.0)
    y = np.arange(10) * 2.0
    assert np.allclose(forecast.solve(x[:, :3], y), np.linalg.lstsq(x[:, :3], y, rcond=None)[0], atol=1e-6)
    assert [forecast.detect_periods(np.arange(9) * g) for g in (300, 3600, 86400)] == [(86400, 43200), (86400, 604800), (604800, 31536000)]


def test_anomaly(spark):
    p = points(spark, [("m", {}, BASE + 300 * i, 1000 if i == 100 else 100 + 20 * np.sin(2 * np.pi * i / 288)) for i in range(200)])
    hits = forecast.anomalies(bucketed(p, 300, "avg")).where("anomaly").collect()
    assert (BASE + 300 * 100) // 300 * 300 in {r["bucket"] for r in hits} and max(r["score"] for r in hits) > 2.5
    flat = points(spark, [("m", {}, 300 * i, 5) for i in range(50)])
    assert forecast.anomalies(bucketed(flat, 300, "avg")).count() == 50


@pytest.mark.parametrize(
    "state, since, hit, tick, duration, want",
    [
        ("ok", None, False, 100, 0, ("ok", None, None)), ("ok", None, True, 100, 0, ("firing", 100, "fire")), ("ok", None, True, 100, 60, ("pending", 100, None)),
        ("pending", 50, True, 100, 60, ("pending", 50, None)), ("pending", 40, True, 100, 60, ("firing", 40, "fire")), ("pending", 50, False, 100, 60, ("ok", None, None)),
        ("firing", 50, True, 100, 60, ("firing", 50, None)), ("firing", 50, False, 100, 60, ("resolved", 50, "resolve")), ("resolved", 50, False, 100, 60, ("ok", None, None)),
        ("resolved", 50, True, 100, 0, ("firing", 50, "fire")), ("resolved", 50, True, 100, 60, ("pending", 50, None)),
    ],
)
def test_alert_machine(spark, state, since, hit, tick, duration, want):
    assert stream_alerts.advance(state, since, hit, tick, duration) == want
    df = spark.createDataFrame([(state, since, hit, tick, duration)], "state string, since long, hit boolean, tick long, duration long")
    c = F.col
    assert tuple(df.select(*alerts.step(c("state"), c("since"), c("hit"), c("tick"), c("duration"))).first()) == want


def test_alert_evaluation(spark):
    rule = alerts.Rule(1, "hot", "cpu", "above", 90.0, 0, webhook_url="http://x")
    p = points(spark, [("cpu", {"host": "a"}, 5990, 95.0), ("cpu", {"host": "b"}, 5990, 10.0)])
    none = spark.createDataFrame([], alerts.STATES)
    states, events = alerts.evaluate(p, [rule], none, 6000)
    assert [(r["state"], r["triggered_at"]) for r in states.collect()] == [("firing", 6000)]
    body = json.loads(alerts.payloads(events, [rule]).first()["body"])
    assert (body["alert"], body["state"], body["labels"], body["value"]) == ("hot", "firing", {"host": "a"}, 95.0)
    states = spark.createDataFrame(states.collect(), alerts.STATES)
    silent, _ = alerts.evaluate(p, [rule], states, 60_000)  # no data: the state stays
    assert silent.first()["state"] == "firing"
    cool = points(spark, [("cpu", {"host": "a"}, 6500, 1.0)])
    states, events = alerts.evaluate(cool, [rule], states, 6590)
    assert states.first()["state"] == "resolved" and events.first()["event"] == "resolve"
    log = events.unionByName(events.withColumn("triggered_at", F.lit(5).cast("long")))
    assert [r["triggered_at"] for r in alerts.search_history(log).collect()] == [6590, 5]
    assert alerts.clear_history(alerts.acknowledge(log, 1, 5), 10**7).count() == 1
    with pytest.raises(ValueError):
        alerts.Rule(1, "x", "m", "equal", 1.0)


def test_alert_window_straddles_buckets(spark):
    p = points(spark, [("m", {}, 1150, 100.0), ("m", {}, 1210, 1.0)])
    assert alerts.rule_values(p, [alerts.Rule(1, "r", "m", "above", 5.0)], 1300).first()["value"] == 1.0


def test_rules_of_one_window_share_a_scan(spark, tmp_path):
    rows = [(m, {"host": h}, 1000 + 50 * i, float(10 * i + len(m))) for m in ("cpu", "disk", "load") for h in ("a", "b") for i in range(8)] + [("cpu", {}, 1200, 7.0)]
    points(spark, rows).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    rules = [alerts.Rule(1, "r", "cpu", "above", 5.0), alerts.Rule(2, "r", "cpu", "above", 5.0, labels={"host": "a"}), alerts.Rule(3, "r", "disk", "below", 5.0, labels={"host": not_eq("a")}), alerts.Rule(4, "r", "none", "above", 1.0), alerts.Rule(5, "r", "cpu", "above", 5.0, aggregate="max")]
    values = lambda df: sorted((r["rule_id"], r["series_key"], r["value"]) for r in df.collect())
    got = alerts.rule_values(p, rules, 1400)
    assert values(got) == sorted(v for r in rules for v in values(alerts.rule_values(p, [r], 1400)))
    assert sorted(r["rule_id"] for r in got.collect()) == [1, 1, 1, 2, 3, 5, 5, 5]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_catalog(spark):
    p = points(spark, [("b", {"x": "1"}, 0, 1), ("a", {"y": "2"}, 0, 1), ("a", {"y": "3"}, 0, 1)])
    assert [r[0] for r in catalog.list_metrics(p).collect()] == ["a", "b"]
    assert [r[0] for r in catalog.label_names(p).collect()] == ["__name__", "x", "y"]
    assert [r[0] for r in catalog.label_values(p, "y").collect()] == ["2", "3"]
    assert catalog.match_series(p, "a", {"y": not_eq("2")}).count() == 1
    with pytest.raises(ValueError):
        catalog.register(spark.createDataFrame([], catalog.METADATA), "m", "summary")
    notes = spark.createDataFrame([(1, 10, "a", None, ["x"], 0), (2, 20, "b", None, ["y", "z"], 0)], catalog.ANNOTATIONS)
    assert catalog.annotations(notes, 10, 20).count() == 2 and catalog.annotations(notes, 0, 99, ["z", "q"]).count() == 1
    assert catalog.delete_annotation(notes, 1).count() == 1


def test_chart(cpu):
    out = chart.collect(query.aggregate_multi(cpu, "cpu_usage_user", {"hostname": regex("host_[01]")}, 60, "avg"))
    picture = chart.svg(out, "cpu", forecast=[(BASE + 400, 5.0)], anomalies=[(BASE, 2.0)], annotations=[(BASE + 60, "deploy")])
    assert picture.count("<polyline") == 3 and "deploy" in picture and picture.count("<circle") == 1
    assert "No data" in chart.svg([])
    assert chart.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]


def test_stream_append_equals_batch(spark, tmp_path):
    p = points(spark, [("m", {"a": str(i % 3)}, 1000 - i, i) for i in range(50)] + [("m", {"a": "0"}, 1000, 0)])
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.POINTS).parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 51


def test_stream_buckets_and_alerts(spark, tmp_path):
    points(spark, [("m", {}, 60 * i, i) for i in range(10)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.POINTS).parquet(str(tmp_path / "in"))
    q = ingest.live_buckets(stream, 300).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["bucket"], r["sum"], r["count"]) for r in spark.table("live").collect()) == [(0, 10.0, 5), (300, 35.0, 5)]
    ticks = stream.select(F.lit(1).cast("long").alias("rule_id"), "series_key", F.col("ts").alias("tick"), "value", F.lit("above").alias("condition"), F.lit(3.0).alias("threshold"), F.lit(120).cast("long").alias("duration"))
    q = stream_alerts.events(ticks).writeStream.format("memory").queryName("ev").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["event"], r["at"]) for r in spark.table("ev").collect()] == [("fire", 360)]


def test_api(spark, tmp_path):
    from tidemark.plans.api import Api

    now = 1_700_001_000
    api = Api(Store(spark, str(tmp_path / "api")), lambda: now)
    assert api.handle("POST", "/api/v1/import", body='{"metric":{"__name__":"cpu","host":"a"},"values":[1,3],"timestamps":[1700000000,1700000060]}')[0] == 204
    status, _, body = api.handle("POST", "/write", body="cpu,host=b value=9 1700000000\nbad\n")
    assert status == 200 and json.loads(body)["errors"] == 1
    assert api.handle("POST", "/api/v1/import/prometheus", body='up{job="x"} 1 1700000000000\n')[0] == 204
    assert json.loads(api.handle("GET", "/health")[2])["points"] == 4
    assert json.loads(api.handle("GET", "/api/v1/query", {"metric": "cpu", "host": "a"})[2])["value"] == 3.0
    assert len(json.loads(api.handle("GET", "/api/v1/query_range", {"metric": "cpu", "start": "1700000000", "end": "1700000100"})[2])["series"]) == 2
    assert json.loads(api.handle("GET", "/api/v1/label/__name__/values")[2])["data"] == ["cpu", "up"]
    assert json.loads(api.handle("GET", "/api/v1/labels")[2])["data"] == ["__name__", "host", "job"]
    got = json.loads(api.handle("GET", "/prometheus/api/v1/query_range", {"query": "max(cpu) by (host)", "start": "1700000000", "end": "1700000100", "step": "600"})[2])
    assert [r["metric"] for r in got["data"]["result"]] == [{"host": "a"}, {"host": "b"}]
    assert json.loads(api.handle("GET", "/prometheus/api/v1/series", {"match[]": "cpu{host!='a'}"})[2])["data"] == [{"host": "b", "__name__": "cpu"}]
    assert api.handle("GET", "/prometheus/api/v1/query", {"query": ""})[0] == 400
    assert api.handle("GET", "/api/v1/query_range", {"metric": "cpu", "step": "x"})[0] == 400
    assert '"timestamps":[1700000000000,1700000060000]' in api.handle("GET", "/api/v1/export", {"metric": "cpu", "host": "a", "start": "0"})[2]
    assert api.handle("GET", "/chart", {"metric": "cpu", "start": "0"})[2].startswith("<svg") and api.handle("GET", "/nope")[0] == 404
    assert "tidemark_total_points 4" in api.handle("GET", "/metrics")[2]


def test_own_statistics_and_scrape_source(spark, tmp_path):
    from tidemark.sources import scrape_source
    from tidemark.streaming import schedule

    got = {r["metric"]: r["value"] for r in schedule.own_statistics(spark, 5, {"writes": 30.0}, {"writes": 10.0}, 10.0).collect()}
    assert got == {"tidemark_writes_total": 30.0, "tidemark_writes_per_second": 2.0}
    (tmp_path / "m").write_text("a 1\nb 2\n")
    reader = scrape_source.Reader({"targets": json.dumps([f"file://{tmp_path}/m", "file:///nowhere"])})
    rows, after = reader.read(reader.initialOffset())
    assert [r[4] for r in rows] == ["a 1", "b 2", None] and after == {"poll": 1}
