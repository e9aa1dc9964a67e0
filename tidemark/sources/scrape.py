"""Scrape targets: validation, health, and what one scrape yields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import LABELS, points
from tidemark.operators import relabel
from tidemark.sources import lines

TARGETS = "id long, job_name string, scheme string, address string, metrics_path string, scrape_interval long, scrape_timeout long, honor_labels boolean, honor_timestamps boolean"
HEALTH = "target_id long, health string, last_scrape long, last_duration_ms long, samples_scraped long, error string"
#: What a target leaves out.
DEFAULTS = {"scheme": "http", "metrics_path": "/metrics", "scrape_interval": 30, "scrape_timeout": 10, "honor_labels": False, "honor_timestamps": True}


def target(spec: Mapping) -> dict:
    """A complete target; job_name and address are required, intervals are positive whole numbers."""
    for k in ("job_name", "address"):
        if not spec.get(k):
            raise ValueError(f"{k} is required")
    out = {**DEFAULTS, **spec}
    for k in ("scrape_interval", "scrape_timeout"):
        if not isinstance(out[k], int) or isinstance(out[k], bool) or out[k] <= 0:
            raise ValueError(f"{k} must be a positive whole number")
    return out


def _row(targets: DataFrame, spec: Mapping) -> DataFrame:
    names = [f.name for f in targets.schema if f.name != "id"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in targets.schema if f.name != "id")
    if bad := set(spec) - set(names) - {"id"}:
        raise ValueError(f"targets have no {', '.join(sorted(bad))}")
    full = target(spec)
    return targets.sparkSession.createDataFrame([tuple(full.get(n) for n in names)], kinds)


def add_target(targets: DataFrame, spec: Mapping) -> DataFrame:
    """The targets and a new one, whose id is above all others."""
    top = targets.agg(F.max("id")).first()[0] or 0
    return targets.unionByName(_row(targets, {k: v for k, v in spec.items() if k != "id"}).withColumn("id", F.lit(top + 1).cast("long")))


def update_target(targets: DataFrame, target_id: int, spec: Mapping) -> DataFrame:
    """The targets with one replaced by a complete new description, under its id."""
    hit = F.col("id") == target_id
    row = _row(targets, {k: v for k, v in spec.items() if k != "id"})
    if not targets.where(hit).take(1):
        return targets
    return targets.where(~hit).unionByName(row.withColumn("id", F.lit(target_id).cast("long")))


def delete_target(targets: DataFrame, health: DataFrame, target_id: int) -> tuple[DataFrame, DataFrame]:
    """(targets, health) without one target."""
    return targets.where(F.col("id") != target_id), health.where(F.col("target_id") != target_id)


def with_health(targets: DataFrame, health: DataFrame) -> DataFrame:
    """Targets with the outcome of their last scrape; unknown where there was none."""
    own = health.withColumnRenamed("target_id", "__id")
    return targets.join(own, targets["id"] == own["__id"], "left").drop("__id").withColumn("health", F.coalesce("health", F.lit("unknown"))).withColumn("samples_scraped", F.coalesce("samples_scraped", F.lit(0).cast("long")))


def scrape_time(ts: Column, now: int, honor: bool = True) -> Column:
    """Seconds of a scraped time: now if times are not honoured or it is 0; above 1e12 it is milliseconds."""
    if not honor:
        return F.lit(now).cast("long")
    return F.when(F.coalesce(ts, F.lit(0)) == 0, F.lit(now).cast("long")).when(ts > 1_000_000_000_000, F.floor(ts / 1000)).otherwise(ts.cast("long"))


def scraped(body: DataFrame, spec: Mapping, now: int, seconds: float, rules: Sequence[Mapping] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of one scrape of ``body`` (line, seq): target labels, relabelling, and the scrape's own metrics."""
    spec = target(spec)
    got = lines.prometheus(body, now, milliseconds=False)
    own = F.create_map(*[F.lit(x) for kv in (("job", spec["job_name"]), ("instance", spec["address"])) for x in kv])
    rows = got.points.withColumn("labels", relabel.honor_labels(F.col("labels"), own, spec["honor_labels"])).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("__name__"), F.col("metric"))))
    rows = relabel.apply(rows, rules).withColumn("metric", F.coalesce(F.col("labels")["__name__"], F.col("metric"))).withColumn("labels", F.map_filter(relabel.drop_meta(F.col("labels")), lambda k, _: k != "__name__"))
    rows = points(rows, F.col("metric"), F.col("labels"), scrape_time(F.col("ts"), now, spec["honor_timestamps"]), F.col("value"), F.col("seq"))
    n = got.points.agg(F.count("*").cast("double").alias("n"))
    mine = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in (("up", F.lit(1.0)), ("scrape_duration_seconds", F.lit(float(seconds))), ("scrape_samples_scraped", F.col("n")))])).alias("m")).select("m.metric", "m.value")
    mine = points(mine, F.col("metric"), own.cast(LABELS), F.lit(now), F.col("value"), F.lit(1 << 40))
    return rows.unionByName(mine), got.errors
