"""Ingest of line formats.  A parser takes (line, seq) and returns (points, text points or None, errors).

Parsers are column expressions throughout.  ``now`` stands in for missing times.
Errors are (line, seq) of the lines that could not be read.  Numbers of lines are LINE
apart, so that the values of a line can be numbered after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import LABELS, points, text_points

#: Distance of the numbers of two lines, and bits for the line inside a file split.
LINE, SPLIT_BITS = 1 << 20, 23
BODY_LIMIT = 10 * 1024 * 1024
_NUMBER = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z"


@dataclass
class Parsed:
    points: DataFrame
    errors: DataFrame
    text: DataFrame | None = None

    def report(self, samples: int = 3, width: int = 200) -> dict:
        """Numbers of samples and errors, and the first failed lines."""
        n = self.points.count() + (self.text.count() if self.text is not None else 0)
        failed = [r["line"] for r in self.errors.orderBy("seq").select(F.substring("line", 1, width).alias("line")).limit(samples).collect()]
        return {"samples": n, "errors": self.errors.count(), "failed_lines": failed}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq) of text files; seq follows the order of splits, and of lines inside a split (of 8 million lines at most)."""
    return numbered(spark.read.text(path).select(F.col("value").alias("line")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with seq by partition and place."""
    place = F.expr(f"__at & {(1 << 33) - 1}")
    fits = F.when(place < (1 << SPLIT_BITS), place).otherwise(F.raise_error(F.lit("a split has too many lines: lower spark.sql.files.maxPartitionBytes")).cast("long"))
    seq = (F.shiftleft(F.shiftrightunsigned("__at", 33), SPLIT_BITS) + fits) * LINE
    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("seq", seq).drop("__at")


def from_text(spark: SparkSession, body: str, first: int = 0) -> DataFrame:
    if len(body.encode()) > BODY_LIMIT:
        raise ValueError("body too large")
    return spark.createDataFrame([(x, first + i * LINE) for i, x in enumerate(body.split("\n"))], "line string, seq long")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` (line, seq) with columns that are computed once a line: filters are not moved before a generator, so they don't spell its results out again."""
    whole = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__r")
    return df.select("line", "seq", whole).select("line", "seq", *[F.col(f"__r.{k}").alias(k) for k in columns])


def vm_json(lines: DataFrame) -> Parsed:
    """``{"metric": {"__name__": ...}, "values": [...], "timestamps": [...]}``, times in seconds.

    Numbers become points, strings text points; any bad element fails its whole line.
    """
    doc = _once(lines.where(F.trim("line") != ""), v=F.expr("try_parse_json(line)"))
    doc = _once(doc, m=F.expr("try_variant_get(v, '$.metric', 'map<string,string>')"), vals=F.expr("try_variant_get(v, '$.values', 'array<variant>')"), tss=F.expr("try_variant_get(v, '$.timestamps', 'array<variant>')"))
    doc = doc.withColumn("vt", F.expr("transform(vals, x -> coalesce(schema_of_variant(x), 'VOID'))")).withColumn("tt", F.expr("transform(tss, x -> coalesce(schema_of_variant(x), 'VOID'))"))
    good = F.expr("m is not null and vals is not null and tss is not null and size(vals) = size(tss) and forall(vt, t -> substring(t, 1, 6) in ('BIGINT', 'DECIMA', 'DOUBLE', 'STRING')) and forall(tt, t -> t = 'BIGINT')")
    doc = doc.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = doc.where("good").select("m", "seq", F.expr("posexplode(arrays_zip(vals, tss, vt))").alias("i", "p"))
    rows = rows.select(F.coalesce(F.col("m")["__name__"], F.lit("unknown")).alias("metric"), F.map_filter("m", lambda k, _: k != "__name__").alias("labels"), F.expr("try_variant_get(p.tss, '$', 'bigint')").alias("ts"), (F.col("seq") + F.col("i")).alias("seq"), F.expr("p.vt = 'STRING'").alias("is_text"), F.expr("try_variant_get(p.vals, '$', 'string')").alias("s"), F.expr("case when p.vt <> 'STRING' then try_variant_get(p.vals, '$', 'double') end").alias("d"))
    c = F.col
    return Parsed(
        points(rows.where("not is_text"), c("metric"), c("labels"), c("ts"), c("d"), c("seq")),
        doc.where("not good").select("line", "seq"),
        text_points(rows.where("is_text"), c("metric"), c("labels"), c("ts"), c("s"), c("seq")),
    )


def _label_pairs(text: Column) -> Column:
    pattern = F.lit(r'([^=, ]+) *="((?:[^"\\]|\\.)*)"')
    return F.map_from_arrays(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)))


def prometheus(lines: DataFrame, now: int, milliseconds: bool = True) -> Parsed:
    """Exposition text.  Quoted values are kept as written; NaN and infinities are errors; times are milliseconds, missing or unreadable ones are now."""
    body = lines.withColumn("t", F.trim(F.rtrim("line", F.lit("\r")))).where("t <> '' and not startswith(t, '#')")
    head = r"^([^{ \t]+)[ \t]*(?:\{([^}]*)\}[ \t]*|[ \t])[ \t]*([^ \t]+)(?:[ \t]+([^ \t]+))?.*$"
    parts = body.select("line", "seq", *[F.regexp_extract("t", head, i).alias(n) for i, n in enumerate(("metric", "pairs", "number", "time"), 1)])
    # Filters get every column they name spelled out, so they name the value, which is null or infinite in bad lines, and once.
    parts = parts.withColumn("value", F.regexp_extract("number", _NUMBER, 0).try_cast("double"))
    at = F.when(F.col("time").rlike(r"^[-+]?[0-9]+$"), F.col("time").try_cast("long"))
    ts = F.when(F.coalesce(at, F.lit(0).cast("long")) == 0, F.lit(now).cast("long")).otherwise(F.expr("try_cast(time as bigint) div 1000L") if milliseconds else at)
    good = F.abs("value") < float("inf")
    ok = parts.where(good).withColumn("labels", F.when(F.col("pairs") == "", F.create_map().cast(LABELS)).otherwise(_label_pairs(F.col("pairs"))))
    return Parsed(points(ok, F.col("metric"), F.col("labels"), ts, F.col("value"), F.col("seq")), parts.where(~F.coalesce(good, F.lit(False))).select("line", "seq"))


_SKIPPED = ("t", "f", "T", "F", "true", "false", "True", "False", "TRUE", "FALSE")


def influx(lines: DataFrame, now: int) -> Parsed:
    """``measurement[,tag=value] field=value[,...] [time]``; numeric fields only; the size of a time tells its unit."""
    body = lines.withColumn("t", F.trim("line")).where("t <> '' and not startswith(t, '#')")
    head = r"^([^ ]+) +([^ ]+)(?: +([^ ]+))? *$"
    parts = body.select("line", "seq", *[F.regexp_extract("t", head, i).alias(n) for i, n in enumerate(("key", "fields", "time"), 1)])
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v"))
    number = lambda v: F.regexp_extract(v, r"^[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", 0)
    pairs = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: F.instr(x, "=") > 1), pair)
    usable = lambda f: ~f.v.startswith('"') & ~f.v.isin(*_SKIPPED) & (number(f.v) != "")
    parts = _once(parts, numeric=F.filter(pairs(F.col("fields")), usable), measurement=F.substring_index("key", ",", 1), key=F.col("key"), time=F.col("time"))
    parts = parts.withColumn("tags", F.map_from_entries(pairs(F.regexp_replace("key", "^[^,]*,?", ""))))
    good = (F.col("measurement") != "") & (F.size("numeric") > 0)
    rows = parts.where(good).select("seq", "measurement", "tags", "time", (F.size("numeric") == 1).alias("one"), F.posexplode("numeric").alias("i", "f"))
    metric = F.when(F.col("one") & (F.col("f.k") == "value"), F.col("measurement")).otherwise(F.concat_ws("_", "measurement", "f.k"))
    at = F.when(F.col("time").rlike(r"^[-+]?[0-9]+$"), F.col("time").try_cast("long"))
    rows = rows.withColumn("at", at)
    unit = "case when at > 1000000000000000000 then at div 1000000000L when at > 1000000000000000 then at div 1000000L when at > 1000000000000 then at div 1000L else at end"
    ts = F.coalesce(F.expr(unit), F.lit(now).cast("long"))
    found = points(rows, metric, F.col("tags"), ts, number(F.col("f.v")).try_cast("double"), F.col("seq") + F.col("i"))
    return Parsed(found, parts.where(~F.coalesce(good, F.lit(False))).select("line", "seq"))
