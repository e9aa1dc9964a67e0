"""Threshold alerts: values of rules, a state machine, replay over ticks, history.

States of one (rule, series): ok, pending, firing, resolved.  A breach makes ok firing
at once without a duration, else pending; pending fires when it has lasted the
duration and is forgotten when the value recovers; firing resolves; resolved is
forgotten, or breaches again with the time it first had.  Series without data in the
window keep their state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matchers import Matcher, label_filter, metric_filter
from tidemark.operators.aggregates import bucketed

LEAST_WINDOW = 600
KEEP_HISTORY = 7 * 86400
STATES = "rule_id long, series_key string, state string, triggered_at long, resolved_at long, value double"
RULES = "id long, name string, metric string, labels map<string,string>, aggregate string, condition string, threshold double, duration long, enabled boolean, webhook_url string"
HISTORY = "rule_id long, series_key string, event string, triggered_at long, value double, acknowledged boolean"


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    metric: str
    condition: str  # above or below
    threshold: float
    duration: int = 0
    aggregate: str = "avg"
    labels: Mapping[str, Matcher | str] = field(default_factory=dict)
    enabled: bool = True
    webhook_url: str | None = None

    def __post_init__(self):
        if self.condition not in ("above", "below"):
            raise ValueError(f"unknown condition {self.condition!r}")

    @property
    def window(self) -> int:
        return max(self.duration, LEAST_WINDOW)


def _row(spark, rule: Rule) -> DataFrame:
    labels = {k: v if isinstance(v, str) else v.op.removeprefix("=") + v.value for k, v in rule.labels.items()}
    return spark.createDataFrame([(rule.id, rule.name, rule.metric, labels, rule.aggregate, rule.condition, float(rule.threshold), rule.duration, rule.enabled, rule.webhook_url)], RULES)


def create_rule(rules: DataFrame, rule: Rule) -> DataFrame:
    """The rules and a new one, whose id is above all others."""
    top = rules.agg(F.max("id")).first()[0] or 0
    return rules.unionByName(_row(rules.sparkSession, rule).withColumn("id", F.lit(top + 1).cast("long")))


def update_rule(rules: DataFrame, states: DataFrame, rule_id: int, **changes) -> tuple[DataFrame, DataFrame]:
    """(rules, states) with some fields of a rule changed; a disabled rule has no states."""
    kinds = {f.name: f.dataType for f in rules.schema}
    if bad := set(changes) - set(kinds) | {"id"} & set(changes):
        raise ValueError(f"rules have no {', '.join(sorted(bad))} to change")
    if changes.get("condition", "above") not in ("above", "below"):
        raise ValueError(f"unknown condition {changes['condition']!r}")
    hit = F.col("id") == rule_id
    out = rules.select(*[F.when(hit, F.lit(changes[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rules.columns])
    return out, states.where(F.col("rule_id") != rule_id) if changes.get("enabled") is False else states


def delete_rule(rules: DataFrame, states: DataFrame, rule_id: int) -> tuple[DataFrame, DataFrame]:
    """(rules, states) without a rule and its states; its history stays."""
    return rules.where(F.col("id") != rule_id), states.where(F.col("rule_id") != rule_id)


def load_rules(rules: DataFrame) -> list[Rule]:
    """Rules of a table, which people write and so is small; label values that begin with ~, !~ or ! are those of the matchers."""
    kinds = {"~": "=~", "!~": "!~", "!": "!=", "!=": "!="}
    matcher = lambda v: next((Matcher(op, v.removeprefix(k)) for k, op in sorted(kinds.items(), key=lambda x: -len(x[0])) if v.startswith(k)), v)
    return [Rule(r["id"], r["name"], r["metric"], r["condition"], r["threshold"], r["duration"], r["aggregate"], {k: matcher(v) for k, v in (r["labels"] or {}).items()}, r["enabled"], r["webhook_url"]) for r in rules.orderBy("id").collect()]


def rule_values(points: DataFrame, rules: Sequence[Rule], now: int) -> DataFrame:
    """(rule_id, series_key, value): last bucket of each rule's window, which ends now.  Buckets follow the epoch, so it usually covers less than the window.

    Rules of the same window and aggregate share one scan: points that any of them asks for are bucketed once, and each series goes to all its rules.
    """
    shared: dict[tuple[int, str], list[Rule]] = {}
    for r in rules:
        shared.setdefault((r.window, r.aggregate), []).append(r)
    parts = []
    for (window, aggregate), same in shared.items():
        hits = [(r.id, metric_filter(r.metric) & label_filter(r.labels)) for r in same]
        wanted = F.coalesce(*[F.when(h, True) for _, h in hits], F.lit(False))
        if all(isinstance(r.metric, str) for r in same):  # names reach the scan, whatever the labels
            wanted = F.col("metric").isin(*sorted({r.metric for r in same})) & wanted
        series = bucketed(points.where(F.col("ts").between(now - window, now) & wanted), window, aggregate)
        ids = F.array_compact(F.array(*[F.when(h, F.lit(i).cast("long")) for i, h in hits]))
        parts.append(series.select(F.explode(ids).alias("rule_id"), "series_key", "bucket", "value").groupBy("rule_id", "series_key").agg(F.max_by("value", "bucket").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def breach(value: Column, condition: Column, limit: Column) -> Column:
    return F.when(condition == "above", value > limit).otherwise(value < limit)


def step(state: Column, triggered_at: Column, hit: Column, tick: Column, duration: Column) -> tuple[Column, Column, Column]:
    """(state, triggered_at, event) after a tick; event is fire, resolve or null."""
    state = F.coalesce(state, F.lit("ok"))
    since = F.when(state == "ok", tick).otherwise(triggered_at)
    after = (
        F.when(hit & state.isin("ok", "resolved"), F.when(duration <= 0, "firing").otherwise("pending"))
        .when(hit & (state == "pending"), F.when(tick - triggered_at >= duration, "firing").otherwise("pending"))
        .when(hit, "firing")
        .when(state == "firing", "resolved")
        .otherwise("ok")
    )
    event = F.when((after == "firing") & (state != "firing"), "fire").when(after == "resolved", "resolve")
    return after, F.when(after == "ok", F.lit(None).cast("long")).otherwise(since), event


def replay(ticks: DataFrame) -> DataFrame:
    """(rule_id, series_key, state, triggered_at, history) after all ticks.

    ``ticks``: rule_id, series_key, tick, value, condition, threshold, duration; one row
    for each tick that has data.  The ticks of one series of one rule are folded in order.
    """
    empty = "cast(array() as array<struct<event:string,at:bigint,value:double>>)"
    grouped = ticks.groupBy("rule_id", "series_key").agg(F.array_sort(F.collect_list(F.struct("tick", "value", "condition", "threshold", "duration"))).alias("ticks"))
    start = F.struct(F.lit("ok").alias("state"), F.lit(None).cast("long").alias("triggered_at"), F.expr(empty).alias("history"))

    def fold(acc: Column, t: Column) -> Column:
        state, since, event = step(acc.state, acc.triggered_at, breach(t.value, t.condition, t.threshold), t.tick, t.duration)
        entry = F.array(F.struct(event.alias("event"), t.tick.alias("at"), t.value.alias("value")))
        return F.struct(state.alias("state"), since.alias("triggered_at"), F.when(event.isNotNull(), F.concat(acc.history, entry)).otherwise(acc.history).alias("history"))

    return grouped.select("rule_id", "series_key", F.aggregate("ticks", start, fold).alias("r")).select("rule_id", "series_key", "r.state", "r.triggered_at", "r.history")


def history(replayed: DataFrame) -> DataFrame:
    """(rule_id, series_key, event, triggered_at, value) of every change; triggered_at is the time of the event."""
    return replayed.select("rule_id", "series_key", F.explode("history").alias("h")).select("rule_id", "series_key", "h.event", F.col("h.at").alias("triggered_at"), "h.value")


def evaluate(points: DataFrame, rules: Sequence[Rule], states: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(new states, new history rows) of one tick over all enabled rules."""
    spark = points.sparkSession
    on = [r for r in rules if r.enabled]
    if not on:
        return states, spark.createDataFrame([], HISTORY)
    values = rule_values(points, on, now)
    table = spark.createDataFrame([(r.id, r.condition, float(r.threshold), r.duration) for r in on], "rule_id long, condition string, threshold double, duration long")
    old = states.select("rule_id", "series_key", "state", "triggered_at", "resolved_at", F.col("value").alias("old_value"))
    rows = values.join(F.broadcast(table), "rule_id").join(old, ["rule_id", "series_key"], "full_outer")
    now_c = F.lit(now).cast("long")
    after, since, event = step(F.col("state"), F.col("triggered_at"), breach(F.col("value"), F.col("condition"), F.col("threshold")), now_c, F.col("duration"))
    seen = F.col("value").isNotNull() & F.col("duration").isNotNull()
    out = rows.select(
        "rule_id", "series_key",
        F.when(seen, after).otherwise(F.col("state")).alias("state"), F.when(seen, since).otherwise(F.col("triggered_at")).alias("triggered_at"),
        F.when(seen & (event == "resolve"), now_c).otherwise(F.col("resolved_at")).alias("resolved_at"), F.coalesce("value", "old_value").alias("value"), F.when(seen, event).alias("event"),
    )
    fresh = out.where("event is not null").select("rule_id", "series_key", "event", now_c.alias("triggered_at"), "value", F.lit(False).alias("acknowledged"))
    return out.where("state <> 'ok'").drop("event"), fresh


def rules_with_states(rules: DataFrame, states: DataFrame) -> DataFrame:
    """Rules, each with an array of its states (empty if there are none)."""
    nested = states.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("series_key", "state", "triggered_at"))).alias("states"))
    return rules.join(nested, rules["id"] == nested["rule_id"], "left").drop("rule_id").withColumn("states", F.coalesce("states", F.expr("cast(array() as array<struct<series_key:string,state:string,triggered_at:bigint>>)")))


def search_history(table: DataFrame, rule_id: int | None = None, acknowledged: bool | None = None, limit: int = 50) -> DataFrame:
    """Newest first."""
    rows = table
    if rule_id is not None:
        rows = rows.where(F.col("rule_id") == rule_id)
    if acknowledged is not None:
        rows = rows.where(F.col("acknowledged") == acknowledged)
    return rows.orderBy(F.desc("triggered_at"), "rule_id", "series_key").limit(limit)


def acknowledge(table: DataFrame, rule_id: int, triggered_at: int) -> DataFrame:
    hit = (F.col("rule_id") == rule_id) & (F.col("triggered_at") == triggered_at)
    return table.withColumn("acknowledged", F.col("acknowledged") | hit)


def clear_history(table: DataFrame, now: int, older_than: int = KEEP_HISTORY, acknowledged_only: bool = True) -> DataFrame:
    gone = F.col("triggered_at") < now - older_than
    return table.where(~(gone & F.col("acknowledged")) if acknowledged_only else ~gone)


def payloads(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(url, body) of the notifications that events call for."""
    rows = [(r.id, r.name, r.metric, float(r.threshold), r.condition, r.aggregate, r.webhook_url) for r in rules if r.webhook_url]
    table = events.sparkSession.createDataFrame(rows, "rule_id long, alert string, metric string, threshold double, condition string, aggregate string, url string")
    state = F.when(F.col("event") == "fire", "firing").otherwise("resolved").alias("state")
    body = F.to_json(F.struct("alert", "metric", F.from_json("series_key", "map<string,string>").alias("labels"), "value", "threshold", "condition", "aggregate", state, "triggered_at", "url"))
    return events.join(F.broadcast(table), "rule_id").select("url", body.alias("body"))


def notify(messages: DataFrame, send: Callable[[str, str], None]) -> None:
    """Sends every message by ``send(url, body)`` on the executors; a failed one does not stop the others."""

    def run(rows):
        for r in rows:
            try:
                send(r["url"], r["body"])
            except OSError:
                continue

    messages.foreachPartition(run)
