"""Requests by path and parameters, without a server: (status, content type, body) for each.

Any web server can call ``Api.handle``.  Results are collected here, at the edge, and
nowhere else, and only up to a number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.duration import chart_step
from tidemark.functions.matchers import Matcher
from tidemark.operators import alerts, catalog, chart, forecast, query
from tidemark.plans import native, promql
from tidemark.sources import export, lines, scrape
from tidemark.store import Store

Response = tuple[int, str, str]
JSON, TEXT, SVG = "application/json", "text/plain", "image/svg+xml"


def _ok(data: object) -> Response:
    return 200, JSON, json.dumps(data)


class Api:
    def __init__(self, store: Store, now: Callable[[], int]):
        self.store, self.now = store, now

    def handle(self, method: str, path: str, params: Mapping[str, str] | None = None, body: str = "") -> Response:
        """404 for unknown paths, 400 for requests that cannot be run, 413 for bodies above the limit."""
        params, parts = dict(params or {}), [p for p in path.split("/") if p]
        try:
            if parts[:2] == ["api", "v1"] and parts[2:3] and parts[2] in ("alerts", "annotations", "metadata", "scrape_targets", "backup") and (method != "GET" or parts[2] != "backup"):
                return self._control(method, parts[2], parts[3:], params, body)
            if method == "POST":
                return self._post(path, body)
            if parts[:1] == ["prometheus"]:
                return self._prometheus(parts[3:], params)
            if path == "/health":
                return self._health()
            if path == "/metrics":
                return 200, TEXT, export.exposition({k: v for k, v in self.store.info().first().asDict().items() if v is not None})
            if path == "/chart":
                return self._chart(params)
            if parts[:2] == ["api", "v1"]:
                return self._api(parts[2:], params)
        except promql.PromQLError as e:
            return 400, JSON, json.dumps({"status": "error", "errorType": "bad_data", "error": str(e)})
        except ValueError as e:
            return 400, JSON, json.dumps({"error": str(e)})
        return 404, JSON, json.dumps({"error": "not found"})

    # -- writes

    def _post(self, path: str, body: str) -> Response:
        parsers = {"/write": lambda x: lines.influx(x, self.now()), "/api/v1/import": lines.vm_json, "/api/v1/import/prometheus": lambda x: lines.prometheus(x, self.now())}
        if path not in parsers:
            return 404, JSON, json.dumps({"error": "not found"})
        if len(body.encode()) > lines.BODY_LIMIT:
            return 413, JSON, json.dumps({"error": "body too large"})
        rows = lines.from_text(self.store.spark, body, self.store.arrivals((body.count("\n") + 1) * lines.LINE))
        parsed = parsers[path](rows)
        self.store.append(parsed.points)
        if parsed.text is not None:
            self.store.append(parsed.text, "text_points")
        report = parsed.report()
        return (200, JSON, json.dumps(report)) if report["errors"] else (204, TEXT, "")

    # -- small tables

    def _control(self, method: str, kind: str, rest: list[str], params: dict, body: str) -> Response:
        sent = json.loads(body or "{}")
        if not isinstance(sent, dict):
            raise ValueError("an object is needed")
        one = int(rest[0]) if rest and rest[0].isdigit() else None
        if kind == "backup":
            return _ok(export.backup({"points": self.store.points(), "text_points": self.store.text(), "tier_daily": self.store.daily()}, str(sent.get("path") or f"{self.store.path}/backups/{self.now()}")))
        if kind == "metadata":
            return self._metadata(method, params | sent)
        return getattr(self, f"_{kind}")(method, one, rest, params, sent)

    def _metadata(self, method: str, sent: dict) -> Response:
        table = self.store.control("metadata", catalog.METADATA)
        if not sent.get("metric"):
            raise ValueError("metric is required")
        if method == "POST":
            self.store.replace("metadata", catalog.register(table, sent["metric"], sent.get("type", "gauge"), sent.get("unit"), sent.get("description")))
            return _ok({"status": "ok"})
        named = self.store.spark.createDataFrame([(sent["metric"],)], "metric string")
        return _ok(catalog.with_metadata(named, table).first().asDict())

    def _annotations(self, method: str, one: int | None, rest: list[str], params: dict, sent: dict) -> Response:
        table, now = self.store.control("annotations", catalog.ANNOTATIONS), self.now()
        if method == "POST":
            self.store.replace("annotations", catalog.add_annotation(table, sent.get("timestamp") or now, sent.get("title", ""), sent.get("description"), sent.get("tags") or (), now))
            return _ok({"status": "created"})
        if method == "DELETE" and one is not None:
            self.store.replace("annotations", catalog.delete_annotation(table, one))
            return _ok({"status": "deleted"})
        tags = [t for t in (params.get("tags") or "").split(",") if t]
        return _ok({"data": [r.asDict() for r in export.bounded(catalog.annotations(table, *native.time_range(params, now), tags))]})

    def _scrape_targets(self, method: str, one: int | None, rest: list[str], params: dict, sent: dict) -> Response:
        table, health = self.store.control("targets", scrape.TARGETS), self.store.control("health", scrape.HEALTH)
        if method == "POST":
            self.store.replace("targets", scrape.add_target(table, sent))
            return _ok({"status": "created"})
        if method == "PUT" and one is not None:
            self.store.replace("targets", scrape.update_target(table, one, sent))
            return _ok({"status": "updated"})
        if method == "DELETE" and one is not None:
            targets, health = scrape.delete_target(table, health, one)
            self.store.replace("targets", targets)
            self.store.replace("health", health)
            return _ok({"status": "deleted"})
        shown = scrape.with_health(table if one is None else table.where(F.col("id") == one), health)
        return _ok({"data": [r.asDict() for r in export.bounded(shown.orderBy("id"))]})

    def _alerts(self, method: str, one: int | None, rest: list[str], params: dict, sent: dict) -> Response:
        rules, states = self.store.control("rules", alerts.RULES), self.store.control("states", alerts.STATES)
        history = self.store.control("history", alerts.HISTORY)
        if rest == ["history"] and method == "GET":
            seen = {"true": True, "false": False}.get(params.get("acknowledged", ""))
            rows = alerts.search_history(history, int(params["rule_id"]) if params.get("rule_id") else None, seen, int(params.get("limit") or 50))
            return _ok({"data": [r.asDict() for r in rows.collect()]})
        if rest == ["history"] and method == "DELETE":
            self.store.replace("history", alerts.clear_history(history, self.now()))
            return _ok({"status": "cleared"})
        if rest == ["acknowledge"] and method == "POST":
            self.store.replace("history", alerts.acknowledge(history, int(sent["rule_id"]), int(sent["triggered_at"])))
            return _ok({"status": "ok"})
        if rest == ["evaluate"] and method == "POST":
            states, fresh = alerts.evaluate(self.store.points(), alerts.load_rules(rules), states, self.now())
            self.store.replace("history", history.unionByName(fresh))
            self.store.replace("states", states.select(*self.store.control("states", alerts.STATES).columns))
            return _ok({"status": "ok"})
        if method == "POST":
            for k in ("name", "metric", "condition", "threshold"):
                if sent.get(k) is None:
                    raise ValueError(f"{k} is required")
            self.store.replace("rules", alerts.create_rule(rules, alerts.Rule(0, sent["name"], sent["metric"], sent["condition"], float(sent["threshold"]), int(sent.get("duration") or 0), native.aggregate_name(sent.get("aggregate")), sent.get("labels") or {}, bool(sent.get("enabled", True)), sent.get("webhook_url"))))
            return _ok({"status": "created"})
        if method in ("PUT", "DELETE") and one is not None:
            rules, states = alerts.update_rule(rules, states, one, **sent) if method == "PUT" else alerts.delete_rule(rules, states, one)
            self.store.replace("rules", rules)
            self.store.replace("states", states)
            return _ok({"status": "updated" if method == "PUT" else "deleted"})
        rows = export.bounded(alerts.rules_with_states(rules if one is None else rules.where(F.col("id") == one), states).orderBy("id"))
        return _ok({"data": [r.asDict(recursive=True) for r in rows]})

    # -- reads

    def _health(self) -> Response:
        info = self.store.info().first()
        return _ok({"status": "ok", "series": info["series_count"], "points": info["total_points"]})

    def _selected(self, params: Mapping[str, str]) -> tuple[DataFrame, str, dict[str, Matcher]]:
        if not params.get("metric"):
            raise ValueError("metric is required")
        return self.store.points(), params["metric"], native.label_params(params)

    def _api(self, parts: list[str], params: dict) -> Response:
        points, now = self.store.points(), self.now()
        if parts == ["query_range"]:
            result, shape, keys = native.query_range(points, params, now)
            if params.get("query"):
                return 200, JSON, export.matrix(result, keys)
            return 200, JSON, export.native(result, shape, keys, params.get("metric"))
        if parts == ["query"]:
            if params.get("query"):
                return self._prometheus(["query"], params)
            rows = [{"labels": r["labels"], "timestamp": r["ts"], "value": r["value"]} for r in export.bounded(query.latest(*self._selected(params), at_most=now).orderBy("series_key"))]
            return _ok(rows[0] if len(rows) == 1 else {"data": rows})
        if parts == ["export"]:
            start, end = native.time_range(params, now)
            rows = export.bounded(export.vm_json_lines(query.select(*self._selected(params), start, end)))
            return 200, TEXT, "".join(r["line"] + "\n" for r in rows)
        if parts == ["labels"]:
            return _ok({"status": "success", "data": [r[0] for r in export.bounded(catalog.label_names(points))]})
        if len(parts) == 3 and parts[0] == "label" and parts[2] == "values":
            rows = catalog.list_metrics(points) if parts[1] == "__name__" else catalog.label_values(points, parts[1], params.get("metric"))
            return _ok({"status": "success", "data": [r[0] for r in export.bounded(rows)]})
        if parts == ["series"]:
            return _ok({"data": [{"labels": r["labels"]} for r in export.bounded(catalog.list_series(points, params.get("metric")))]})
        if parts in (["forecast"], ["anomalies"]):
            return self._analytics(parts[0], params)
        return 404, JSON, json.dumps({"error": "not found"})

    def _buckets(self, params: dict, step: int | None = None) -> tuple[DataFrame, int]:
        start, end = native.time_range(params, self.now())
        step = native.duration_seconds(params["step"]) if params.get("step") else step or 300
        return query.aggregate_multi(*self._selected(params), step, "avg", start, end, native.transforms.parse(params.get("transform"))), step

    def _analytics(self, kind: str, params: dict) -> Response:
        series, step = self._buckets(params)
        if kind == "forecast":
            rows = export.bounded(forecast.forecast(series, native.duration_seconds(params.get("horizon") or "3600"), step).orderBy("series_key", "bucket"))
            data = [{"series": json.loads(r["series_key"]), "timestamp": r["bucket"], "value": r["value"]} for r in rows]
        else:
            rows = export.bounded(forecast.anomalies(series, params.get("sensitivity", "medium")).where("anomaly").orderBy("series_key", "bucket"))
            data = [{"series": json.loads(r["series_key"]), "timestamp": r["bucket"], "value": r["value"], "expected": r["expected"], "score": round(r["score"], 2)} for r in rows]
        return _ok({"metric": params["metric"], "data": data})

    def _chart(self, params: dict) -> Response:
        """Series, with the forecast of the first and the anomalies of all if they are asked for."""
        series, step = self._buckets(params, chart_step(*native.time_range(params, self.now())))
        drawn = chart.collect(series)
        ahead, odd = [], []
        if params.get("forecast") and drawn:
            rows = forecast.forecast(series, native.duration_seconds(params["forecast"]), step).orderBy("series_key", "bucket").collect()
            ahead = [(r["bucket"], r["value"]) for r in rows if r["series_key"] == rows[0]["series_key"]]
        if params.get("anomalies"):
            odd = [(r["bucket"], r["value"]) for r in forecast.anomalies(series, params["anomalies"]).where("anomaly").collect()]
        return 200, SVG, chart.svg(drawn, params["metric"], forecast=ahead, anomalies=odd)

    def _prometheus(self, parts: list[str], params: dict) -> Response:
        points, now = self.store.points(), self.now()
        if parts == ["query_range"]:
            start, end = int(float(params.get("start") or now - native.DEFAULT_RANGE)), int(float(params.get("end") or now))
            result, keys = promql.execute(points, params.get("query", ""), start, end, native.duration_seconds(params.get("step") or "60"))
            return 200, JSON, export.matrix(result, keys)
        if parts == ["query"]:
            at = int(float(params.get("time") or now))
            result, keys = promql.instant(points, params.get("query", ""), at)
            return 200, JSON, export.vector(result, at, keys)
        if parts == ["series"]:
            p = promql.selector_of(promql.parse(params.get("match[]", "")))
            rows = export.bounded(catalog.match_series(points, p.metric, p.labels))
            return _ok({"status": "success", "data": [{**r["labels"], "__name__": r["metric"]} for r in rows]})
        return self._api(parts, params)
