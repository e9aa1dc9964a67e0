"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
Every query is written to the no-op sink after one warm-up query has started the session.
The ingest queries among them also build the lines that they read.  ``points_per_sec``
times the parsers alone, on text files that hold each event COPIES times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "flagship_top_users", "raw_exact_q1", "raw_multi_q2", "agg_avg_a1", "agg_rate_a6", "agg_last_a7", "bucket_minute_w2", "grouped_avg_q6", "grouped_two_keys_q6", "grouped_missing_label_q6",
    "threshold_gt_f8", "top_n_q9", "latest_multi_q11", "promql_single_groupby_l8", "promql_double_groupby_l8", "promql_high_cpu_l1", "promql_rate_l4", "rollup_daily_r1", "ring_buffer_r5", "text_rle_c1",
    "ingest_vmjson_s6", "ingest_prometheus_s7", "ingest_influx_s9", "export_vmjson_k1", "relabel_replace_b1", "forecast_t4", "anomaly_zscore_t5", "alert_replay_e4",
)

COPIES = 10


def parsers(spark, d: str) -> dict[str, int]:
    """Points a second of each parser, from text files to the no-op sink."""
    from pyspark.sql import functions as F

    from tidemark import model
    from tidemark.sources import lines

    events = model.from_events(spark.read.parquet(f"{d}/events.parquet")).withColumn("user", F.col("labels")["user"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    value, ts = F.col("value").cast("string"), F.col("ts").cast("string")
    forms = {
        "vm_json": F.format_string('{"metric":{"__name__":"%s","user":"%s"},"values":[%s],"timestamps":[%s]}', "metric", "user", value, ts),
        "prometheus": F.format_string('%s{user="%s"} %s %s000', "metric", "user", value, ts),
        "influx": F.format_string("%s,user=%s value=%s %s000000000", "metric", "user", value, ts),
    }
    parse = {"vm_json": lines.vm_json, "prometheus": lambda x: lines.prometheus(x, 0), "influx": lambda x: lines.influx(x, 0)}
    base, rate = tempfile.mkdtemp(prefix="bench-"), {}
    for name, line in forms.items():
        path = f"{base}/{name}"
        events.select(line.alias("value")).repartition(spark.sparkContext.defaultParallelism).write.text(path)
        n = spark.read.text(path).count()
        t = time.perf_counter()
        parse[name](lines.read(spark, path)).points.write.format("noop").mode("overwrite").save()
        rate[name] = round(n / (time.perf_counter() - t))
    return rate


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import catalogue
    from tidemark.session import SETTINGS

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    run = lambda name: queries[name](spark, d).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - t, 4)
    rate = parsers(spark, d)
    spark.stop()
    sf = float(os.path.basename(d.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(d.rstrip("/")).startswith("sf") else d
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "points_per_sec": rate, "sf": sf}))


if __name__ == "__main__":
    main()
