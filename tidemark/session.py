"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ensure(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS applied (all of them can be set at run time)."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def create(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark").config(map=SETTINGS | conf)
    return ensure((builder.master(master) if master else builder).getOrCreate())
