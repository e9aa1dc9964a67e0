"""Shared plumbing: run a numpy or Python routine over whole texts, batch by batch.

``map_texts`` appends columns that a routine computes from one text column.  The
routine sees slices of at most ``SLICE_BYTES`` of text (one text is never cut), so
its scratch memory does not follow the Arrow batch size.  Rows are passed through
in place: no shuffle, nothing is kept between tasks, a lost executor only repeats
its own partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a routine is given at once (more only if one text is longer).
SLICE_BYTES = 1 << 21

Routine = Callable[[list[bytes]], dict[str, Sequence]]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most ``limit`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, make: Callable[[], Routine], fields: list[T.StructField], text: str = "text") -> DataFrame:
    """``df`` with ``fields`` appended, computed from column ``text`` (null: empty).

    ``make`` is called once in each task and returns the routine.  A column of
    ``df`` that has the name of a new field is replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new or c == text]
    src = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in kept])
    schema = T.StructType(list(src.schema.fields) + fields)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        routine, out_schema = make(), None
        for batch in batches:
            if out_schema is None:
                own = to_arrow_schema(T.StructType(fields))
                out_schema = pa.schema([*batch.schema, *own])
            texts = texts_of(batch.column(at))
            for a, b in slices(texts):
                got = routine(texts[a:b])
                cols = [x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type, from_pandas=False) for f in own]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *cols], schema=out_schema)

    return src.mapInArrow(run, schema)


#: Word separators: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i below n."""
    if len(_powers["p"]) < n:
        for k, base in (("p", _P), ("i", _INV)):
            x = np.full(n + n // 4, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of several texts at once.

    ``buf``: the texts, a line feed after each; ``bounds``: where each begins (and
    the end); ``start`` and ``end``: of each word; ``first``: index of each text's
    first word (and the number of words).  ``separators`` must hold the line feed.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, separators: np.ndarray = SPACES):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        self.buf = LOWER[buf] if lower else buf
        self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.inside = ~separators[self.buf]
        edge = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.bounds)

    def prefix(self) -> np.ndarray:
        """Prefix sums of the polynomial hash over all bytes."""
        p, _ = powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of the given spans."""
        prefix = self.prefix() if prefix is None else prefix
        start, end = (self.start, self.end) if start is None else (start, end)
        _, inv = powers(len(self.buf) + 1)
        return mix((prefix[end] - prefix[start]) * inv[start])

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[k : k + m]
    return mix(out)


def per_doc(cumulated: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Differences of a cumulated count (with a leading zero) at the bounds."""
    return cumulated[bounds[1:]] - cumulated[bounds[:-1]]


def counted(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out
