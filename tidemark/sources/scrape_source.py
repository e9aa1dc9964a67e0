"""A stream that polls scrape targets: ``spark.readStream.format("tidemark_scrape")``.

Options: ``targets`` (JSON list of URLs), ``timeout`` (seconds).  Each micro-batch holds the
lines of one poll of every target, with the target, the time and the seconds it took; a
target that cannot be read gives one row without a line.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "target string, polled_at long, seconds double, seq long, line string"


def poll(url: str, timeout: float) -> Iterator[tuple]:
    began = time.time()
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            body = r.read().decode("utf-8", "replace").splitlines()
    except OSError:
        yield url, int(began), time.time() - began, 0, None
        return
    took = time.time() - began
    for i, line in enumerate(body):
        yield url, int(began), took, i, line


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.targets, self.timeout = json.loads(options.get("targets", "[]")), float(options.get("timeout", 10))

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [r for t in self.targets for r in poll(t, self.timeout)]
        return iter(rows), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([])  # a poll that was lost cannot be repeated


class ScrapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_scrape"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScrapeSource)
