"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(f"file://{named}")
        spark.conf.set("spark.checkpoint.dir", f"file://{named}")
    return named.rstrip("/")


class Saved:
    """A table in the shared folder; ``df`` reads it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        _kept.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Only for tables that no later plan reads."""
        _delete(self.spark, self.path)
        _kept.remove((self.spark, self.path))


def save(df: DataFrame) -> DataFrame:
    return Saved(df).df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        with contextlib.suppress(Exception):
            _delete(spark, path)
