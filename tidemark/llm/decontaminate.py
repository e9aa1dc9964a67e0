"""Benchmark decontamination by spaced-seed hashing.

Fixed masks keep some positions of a window and ignore the others, so it still hashes
alike when words at ignored positions were substituted.  Any nine words in a row of
which six are equal, or twelve of which eight are, hold such a window.

1. Items are numbered and written with the hashes of their words; their masked windows
   are the rows (h, item, place).
2. Masked windows of all documents pass a bitmap of the items' hashes (of at most
   2**FILTER_BITS bits, so its size is bounded) and are joined with them on h.  Each
   match aligns a text with an item at one shift (no gaps).
3. For every such line the words of the text beside the item are cut out, joined with
   the item's words, and compared in place.

A document leaks an item if at least ``SHARE`` of the item's words are equal in place,
which is then reported from the first equal word to the last; or else if the best-scoring
stretch has at least ``LEAST`` equal words, where equal words add one and different ones
take two off.  Words are lower-cased and cut at everything that is neither letter nor
digit.  Equal texts are compared once: texts are named by their 128-bit hash.

Cases: items of fewer than ``SHORTEST`` words are no evidence and never match;
null and empty texts match nothing; a null item_id is reported as null; repeated
rows each get the result; equal items are all reported; an empty table on either
side gives no leaks; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import Words, mix, slices, texts_of
from tidemark.llm.near import NOT_WORD, bits_of, candidate_bits
from tidemark.llm.store import save

SHORTEST, LEAST = 8, 12
#: Equal words, of so many words of the item, that are a leak in any case.
SHARE = (2, 3)
#: 1 is compared, 0 is ignored.  They cover all choices of 6 equal words of 9, and of 8 of 12.
MASKS = ("1111", "11011", "1010101", "1100011", "11000011", "1101001")
SEEDS = [(m, k + 1) for k, m in enumerate(MASKS)]
#: Bits of the filter for each hash of the benchmark, and of the whole filter (as a power of two) at most.
BITS_EACH, FILTER_BITS = 256, 27
#: Parts that the rows of one item are dealt to where they are compared.
SALTS = 16

LEAKS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "equal_words", "stretch_words", "item_words", "start_word")]))


def _hashes(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, seed, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0xC2B2AE3D27D4EB4F)
            out += words[k : k + m]
    return mix(out)


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n, words, h, place) for (k, text)."""
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            words = Words([t], lower=True, separators=NOT_WORD).hashes()
            hs = [_hashes(words, mask, seed) for mask, seed in SEEDS] if len(words) >= SHORTEST else []
            places = np.concatenate([np.arange(len(h)) for h in hs]) if hs else []
            hs = np.concatenate(hs).view(np.int64) if hs else []
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(words)]), pa.array([words.tobytes()]), pa.array([hs], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.int64()))], names=["k", "n", "words", "h", "place"])


def _matches(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, h, at): masked windows of ``texts`` (node, text) whose hash may be one of ``seeds`` (h)."""
    n = max(1, seeds.count())
    width = min(FILTER_BITS, max(15, math.ceil(math.log2(BITS_EACH * n))))
    shared = texts.sparkSession.sparkContext.broadcast(bits_of(seeds.select(F.shiftrightunsigned("h", 64 - width).alias("at")), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = shared.value, np.uint64(64 - width)
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in slices(texts):
                w = Words(texts[a:b], lower=True, separators=NOT_WORD)
                words, doc = w.hashes(), w.doc_of_words()
                for mask, seed in SEEDS:
                    h = _hashes(words, mask, seed)
                    top = h >> shift
                    at = np.flatnonzero((bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)
                    at = at[doc[at] == doc[at + len(mask) - 1]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([nodes[a + d] for d in doc[at]], pa.binary()), pa.array(h[at].view(np.int64)), pa.array(at - w.first[doc[at]])], names=["node", "h", "at"])

    return texts.mapInArrow(run, "node binary, h long, at long")


def _beside(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, k, n, from, at, part): the words of a text from word ``at`` on that lie beside words ``from`` and following of the item."""
    of_text = save(lines.groupBy("node").agg(F.collect_list(F.struct("k", "n", "shift")).alias("lines")))
    shared = texts.sparkSession.sparkContext.broadcast(candidate_bits(of_text.select("node")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            h = np.array([int.from_bytes(x[:8], "big") for x in batch.column(0).to_pylist()], np.uint64) & mask
            yield batch.filter(pa.array((bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t, found in zip(batch.column("node").to_pylist(), texts_of(batch.column("text")), batch.column("lines").to_pylist(), strict=True):
                words = Words([t], lower=True, separators=NOT_WORD).hashes()
                rows = [(x["k"], x["n"], a - x["shift"], a, words[a : min(x["shift"] + x["n"], len(words))].tobytes()) for x in found for a in [max(x["shift"], 0)]]
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(rows), pa.binary()), *(pa.array(c) for c in zip(*rows, strict=True))], names=["node", "k", "n", "from", "at", "part"])

    kept = texts.mapInArrow(likely, "node binary, text string").join(of_text, "node")
    return kept.dropDuplicates(["node"]).select("node", "text", "lines").mapInArrow(cut, "node binary, k long, n long, from long, at long, part binary")


def compare(item: np.ndarray, part: np.ndarray, first: int) -> tuple[int, int, int] | None:
    """(equal words, words of the stretch, where it begins in ``part``) if words beside ``item[first:]`` are a leak."""
    equal = part == item[first : first + len(part)]
    same = int(equal.sum())
    if same * SHARE[1] >= len(item) * SHARE[0]:
        at = np.flatnonzero(equal)
        return same, int(at[-1] - at[0]) + 1, int(at[0])
    if same < LEAST:
        return None
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    floor = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - floor))
    start = int(np.flatnonzero(gain[: end + 1] == floor[end])[-1])
    same = int(equal[start:end].sum())
    return (same, end - start, start) if same >= LEAST else None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "k", "n", "equal", "shift", "stretch", "start"]
    for batch in batches:
        out = []
        for node, k, n, first, at, part, words in zip(*(batch.column(c).to_pylist() for c in ("node", "k", "n", "from", "at", "part", "words")), strict=True):
            got = compare(np.frombuffer(words, np.uint64), np.frombuffer(part, np.uint64), first)
            if got:
                out.append((node, k, n, got[0], at - first, got[1], at + got[2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


def leaking_texts(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(node, leaks): the texts among ``texts`` (node, text) that leak items."""
    numbered = save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.monotonically_increasing_id()))
    items = save(numbered.select("k", "text").mapInArrow(_items, "k long, n long, words binary, h array<long>, place array<long>"))
    seeds = save(items.select("k", "n", F.explode(F.arrays_zip("h", "place")).alias("s")).select("k", "n", "s.h", "s.place"))
    lines = _matches(texts, seeds).join(seeds, "h").select("node", "k", "n", (F.col("at") - F.col("place")).alias("shift")).distinct()
    parts = _beside(texts, lines).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    salted = items.select("k", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = parts.join(salted, ["k", "salt"]).mapInArrow(_compare, "node binary, k long, n long, equal long, shift long, stretch long, start long")
    # Of several lines of a text and an item the one with most equal words, then the first.
    best = found.groupBy("node", "k", "n").agg(F.max(F.struct("equal", (-F.col("shift")).alias("early"), "stretch", "start")).alias("b"))
    named = best.join(numbered.select("k", "item_id"), "k")
    leak = F.struct(F.col("item_id").isNull().alias("none"), "item_id", "k", F.struct("item_id", F.col("b.equal").alias("equal_words"), F.col("b.stretch").alias("stretch_words"), F.col("n").alias("item_words"), F.col("b.start").alias("start_word")).alias("leak"))
    return save(named.groupBy("node").agg(F.array_sort(F.collect_list(leak)).alias("x")).select("node", F.transform("x", lambda x: x.leak).cast(LEAKS).alias("leaks")))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array column ``leaks``."""
    own = docs.drop("leaks").withColumn("__node", _node(F.col(f"`{text}`")))
    found = leaking_texts(own.select(F.col("__node").alias("node"), F.col(f"`{text}`").cast("string").alias("text")), benchmark)
    out = own.join(found, F.col("__node") == F.col("node"), "left").drop("__node", "node")
    return out.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with the columns of ``docs``."""
    own = docs.withColumn("__node", _node(F.col("text")))
    found = leaking_texts(own.select(F.col("__node").alias("node"), F.col("text").cast("string").alias("text")), benchmark).select(F.col("node").alias("__leaking"))
    return own.join(found, F.col("__node") == F.col("__leaking"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _node(F.col("text")).alias("node"), "text")
    found = leaking_texts(docs.select("node", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select("doc_id", "node").join(found, "node").select("doc_id", F.inline("leaks"))
