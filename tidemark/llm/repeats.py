"""Exact removal of repeated passages by column-wise suffix sorting.

A byte goes if some string of ``WIDTH`` bytes covers it that also starts earlier (in a
document of smaller id, or in the same one further left).  Matches stay inside
documents; all strings are judged on the input.

Every window of WIDTH bytes is assigned to the least-hashed of its GRAM-byte strings
(the leftmost of equals).  Equal windows choose equal grams at equal places, so windows
are compared only inside a gram's bucket, and neighbouring windows with the same gram
travel as one stretch:

1. Stretches (gram, hash of the stretch, document, start) are pre-aggregated in the map
   task and shuffled on the gram.  Grams that occur once are done.  Of equal stretches
   all but the first are wholly repeated.
2. Grams that occur in different stretches: their bytes are fetched, and buckets of
   bounded size are sorted by column-wise construction of the Burrows-Wheeler transform
   and the common prefixes (``bcr``).  In each class of equal windows all but the first
   are repeated.
3. A gram with more than HOT different stretches would make one bucket too large: its
   windows are grouped by 128-bit hashes instead, which no single task has to hold.

Whole documents, a third of all rows in one group of copies, and texts longer than any
slice are handled alike: pieces overlap by WIDTH - 1 bytes.

Cases: null text is empty; texts shorter than WIDTH lose nothing; repeated rows (same id,
same text) are one document and get the same result; rows without doc_id come after all
others, in an order given by their text; an empty table gives an empty result; extra
columns are left out.  Different texts of one id are different documents, in the order
of their hashes (``part``: 0 for ids that name one text).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bcr
from tidemark.llm.arrow_text import mix, powers
from tidemark.llm.store import save

WIDTH, GRAM = 100, 32
#: Different stretches in one sorting bucket, about; above HOT a gram gets no bucket of its own.
BUCKET, HOT = 2048, 32_768
#: Window starts in one piece of text, and bytes of text whose stretches a map task aggregates at once.
PIECE, FLUSH = 1 << 21, 1 << 24
_PLACE_BITS = np.uint64(24)


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, inverse powers, and the hash of the GRAM bytes at every place."""
    p, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    n = max(0, len(buf) - GRAM + 1)
    return sums, inv, mix((sums[GRAM:] - sums[:n]) * inv[:n]) if n else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - have : width - have + n])


def stretches(pieces: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """Rows (gram, content, document, part, start, windows, place of the gram) for (document, part, offset, bytes)."""
    buf = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    if len(buf) < WIDTH:
        return np.zeros((7, 0), np.int64)
    off = np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])])
    sums, inv, h = _grams(buf)
    key = ((h >> _PLACE_BITS) << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_min(key, WIDTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(least))
    piece = np.searchsorted(off, start, "right") - 1
    whole = start + WIDTH <= off[piece + 1]
    start, least, piece = start[whole], least[whole], piece[whole]
    if not len(start):
        return np.zeros((7, 0), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    a, b, g, p = start[first], start[last], least[first], piece[first]
    shape = (g - a).astype(np.uint64) * np.uint64(0x9E3779B1) + (b - a).astype(np.uint64) * np.uint64(0x85EBCA77C2B2)
    content = mix((sums[b + WIDTH] - sums[a]) * inv[a] + mix(shape))
    doc, part, base = (np.array([x[k] for x in pieces], np.int64) for k in range(3))
    return np.stack([h[g].view(np.int64), content.view(np.int64), doc[p], part[p], base[p] + a - off[p], b - a + 1, g - a])


def pieces_of(doc: int, part: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    for a in range(0, max(1, len(text) - WIDTH + 1), PIECE):
        yield doc, part, a, text[a : a + PIECE + WIDTH - 1]


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (gram, content) the first by document and start; and the (document, part, start, windows) of the others."""
    rows = rows[:, np.lexsort(rows[4::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (rows[2:5] != rows[2:5, lead]).any(axis=0)
    return rows[:, new], rows[2:6, again]


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("windows", pa.int16()), ("place", pa.int16()), ("known", pa.binary())])
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        firsts, known = _firsts(np.concatenate(held, axis=1))
        n = firsts.shape[1]
        at = np.zeros(n, bool)
        at[0] = bool(known.shape[1])
        column = pa.array([known.T.tobytes() if x else None for x in at], pa.binary())
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int16, np.int16)
        return pa.RecordBatch.from_arrays([*[pa.array(r.astype(k)) for r, k in zip(firsts, kinds, strict=True)], column], schema=schema)

    waiting: list[tuple[int, int, int, bytes]] = []
    wait = 0
    for batch in batches:
        for doc, part, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for piece in pieces_of(doc, part, text or b""):
                if len(piece[3]) < WIDTH:
                    continue
                waiting.append(piece)
                wait += len(piece[3])
                if wait >= PIECE:
                    held.append(stretches(waiting))
                    size += wait
                    waiting, wait = [], 0
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
    if waiting:
        held.append(stretches(waiting))
    if sum(x.shape[1] for x in held):
        yield flush()


def _runs(doc: np.ndarray, part: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Distinct (doc, part, start) of windows, neighbours joined to (doc, part, start, windows)."""
    order = np.lexsort([start, part, doc])
    doc, part, start = doc[order], part[order], start[order]
    other = np.ones(len(doc), bool)  # than the one before: of another document
    other[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    keep = other.copy()
    keep[1:] |= start[1:] != start[:-1]
    doc, part, start, other = doc[keep], part[keep], start[keep], other[keep]
    other[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(other)
    return pd.DataFrame({"doc": doc[first], "part": part[first].astype(np.int32), "start": start[first].astype(np.int32), "windows": np.diff(np.append(first, len(doc))).astype(np.int32)})


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    string, at, same = bcr.repeats([bytes(b) for b in pdf["bytes"]], WIDTH)
    doc, part, start = pdf["doc"].to_numpy()[string], pdf["part"].to_numpy()[string], pdf["start"].to_numpy()[string].astype(np.int64) + at
    order = np.lexsort([start, part, doc, same])
    doc, part, start, same = doc[order], part[order], start[order], same[order]
    new = np.ones(len(same), bool)
    new[1:] = same[1:] != same[:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[lead]) | (part != part[lead]) | (start != start[lead])
    return _runs(doc[again], part[again], start[again])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted stretch of each document."""
    for pdf in batches:
        for k in range(0, len(pdf), 32):
            out = [(g, d, p, s, t[s : s + n + WIDTH - 1]) for d, p, t, gs, ss, ns in pdf.iloc[k : k + 32].itertuples(index=False) for g, s, n in zip(gs, ss, ns, strict=True)]
            yield pd.DataFrame(out, columns=["gram", "doc", "part", "start", "bytes"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for d, p, s, b in zip(pdf["doc"], pdf["part"], pdf["start"], pdf["bytes"], strict=True):
            hs = [hashlib.blake2b(b[i : i + WIDTH], digest_size=16).digest() for i in range(len(b) - WIDTH + 1)]
            yield pd.DataFrame({"h": hs, "doc": d, "part": p, "start": np.arange(s, s + len(hs), dtype=np.int32)})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    for batch in batches:
        out = []
        for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text or b""
            packed = runs.values.to_numpy(zero_copy_only=False).astype(np.int64) if runs.is_valid else np.zeros(0, np.int64)
            if not len(packed):
                out.append((doc, text, len(text), 0, 0))
                continue
            start, windows = packed >> 32, packed & 0xFFFFFFFF
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, np.minimum(start + windows + WIDTH - 1, len(text)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))
            out.append((doc, np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), int(gone.sum()), spans))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(doc, part, start, windows): all windows of ``texts`` (doc, part, bytes) that also start earlier."""
    spark = texts.sparkSession
    place = "doc long, part int, start int"
    rows = texts.mapInArrow(_map, f"gram long, content long, {place}, windows short, place short, known binary")
    rows = rows.repartition(_partitions(spark, texts), "gram")
    gram = Window.partitionBy("gram")
    equal = Window.partitionBy("gram", "content").orderBy("doc", "part", "start")
    here = F.struct("doc", "part", "start")
    rows = rows.withColumn("n", F.count("*").over(gram)).where("n > 1 or known is not null")
    rows = rows.withColumn("lead", F.first(here).over(equal)).withColumn("first", F.row_number().over(equal) == 1)
    rows = rows.withColumn("kinds", F.sum(F.col("first").cast("long")).over(gram))
    rows = save(rows.select("gram", "doc", "part", "start", "windows", "known", "kinds", "first", (F.col("lead") != here).alias("again")))

    local = rows.where("known is not null").select("known").mapInArrow(_unpack, f"{place}, windows int")
    whole = rows.where("again").select("doc", "part", "start", F.col("windows").cast("int").alias("windows"))
    wanted = rows.where("first and kinds > 1").groupBy("doc", "part").agg(*[F.collect_list(c).alias(c) for c in ("gram", "start", "windows")])
    cut = wanted.join(texts.dropDuplicates(["doc", "part"]), ["doc", "part"]).select("doc", "part", "bytes", "gram", "start", "windows").mapInPandas(_cut, f"gram long, {place}, bytes binary")
    counts = rows.where("first and kinds > 1").groupBy((F.col("kinds") > HOT).alias("hot")).count().collect()
    sizes = {r["hot"]: r["count"] for r in counts}
    out = [local, whole]
    if sizes.get(False):
        tasks = math.ceil(sizes[False] / BUCKET)
        cool = cut if not sizes.get(True) else cut.join(rows.where(f"first and kinds > {HOT}").select("gram").distinct(), "gram", "left_anti")
        out.append(cool.groupBy(F.pmod(F.xxhash64("gram"), F.lit(tasks)).alias("bucket")).applyInPandas(_sort_bucket, f"{place}, windows int"))
    if sizes.get(True):
        hot = cut.join(rows.where(f"first and kinds > {HOT}").select("gram").distinct(), "gram", "left_semi")
        same = Window.partitionBy("h").orderBy("doc", "part", "start")
        windows = hot.select("doc", "part", "start", "bytes").mapInPandas(_windows, f"h binary, {place}")
        again = windows.withColumn("lead", F.first(here).over(same)).where(F.col("lead") != here)
        out.append(again.select("doc", "part", "start", F.lit(1).alias("windows")))
    runs = out[0]
    for x in out[1:]:
        runs = runs.unionByName(x)
    return runs


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column(0).to_pylist():
            x = np.frombuffer(b, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), *(pa.array(x[:, k].astype(np.int32)) for k in (1, 2, 3))], names=["doc", "part", "start", "windows"])


def _partitions(spark: SparkSession, texts: DataFrame) -> int:
    """About 8 MB of text for each shuffle partition."""
    n = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / (8 << 20)))


def _parts(own: DataFrame) -> DataFrame:
    """(doc, h, part): the texts, by hash, of ids that name several."""
    kinds = own.select("doc", "h").distinct()
    several = kinds.groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("doc")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1
    return save(kinds.join(several, "doc").select("doc", "h", number.cast("int").alias("part")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) of every row; kept: the remaining bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)  # ids of rows that have none
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text, "utf-8").alias("bytes"), F.coalesce(F.col("doc_id").cast("long"), late).alias("doc"), F.xxhash64(text).alias("h"))
    own = own.join(_parts(own), ["doc", "h"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    runs = repeated_runs(own.select("doc", "part", "bytes"))
    packed = runs.groupBy("doc", "part").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("windows")).alias("runs"))
    return own.join(packed, ["doc", "part"], "left").select("doc_id", "bytes", "runs").mapInArrow(_remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
