"""Quality rules: gradient-boosted trees over document statistics.

Each document is reduced to a vector of statistics, vectorised over slices of
texts.  Trees are fitted in numpy on the driver from a bounded sample of labelled
rows and flattened into node arrays; scoring walks all rows of a slice through
the arrays at once.  Some statistics (share of symbols, of repeated words, of
repeated lines) may only lower the score: their splits are constrained.

Cases: a null or empty text has no words and fails the base rules; nulls in other
columns, repeated rows and extra columns pass through; an empty table gives an
empty result; without labels of both classes the base rules alone decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import Words, counted, map_texts, mix, ngram_hashes, per_doc

#: Rows of labels that the trees are fitted on at most.
SAMPLE_ROWS = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics as the trees see them, and the direction in which each may move the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": 0, "digit_share": 0, "punctuation_share": 0, "pipe_share": 0, "long_word_share": 0, "words_per_line": 0, "stop_marks": 0,
}


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Marks all but the first of equal keys."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text, and its vector of FEATURES."""
    w = Words(texts)
    n_docs, buf, inside = len(texts), w.buf, w.inside
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    doc = w.doc_of_words()
    prefix = w.prefix()
    words = w.hashes(prefix)
    n = np.diff(w.first)
    chars = counted(inside & ((buf & 0xC0) != 0x80))
    word_chars = per_doc(chars, w.bounds)
    n_symbols = per_doc(counted(SYMBOLS[buf]), w.bounds)

    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1]).astype(np.int64)
    full = chars[line_end] > chars[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(w.bounds, line_start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n_docs)
    later = _later(mix(w.hashes(prefix, line_start, line_end) ^ salt[line_doc]))
    n_dup_lines = np.bincount(line_doc[later], minlength=n_docs)

    covered = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        again = at[_repeated(mix(ngram_hashes(words, 3)[at] ^ salt[doc[at]]))]
        for k in range(3):
            covered[again + k] = True
    n_repeat = np.bincount(doc[covered[: len(words)]], minlength=n_docs)
    n_distinct = n - np.bincount(doc[_later(words ^ salt[doc])], minlength=n_docs)

    length = chars[w.end] - chars[w.start]
    last = buf[w.end - 1] if len(words) else np.zeros(0, np.uint8)
    counts = {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    is_upper, is_digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    is_mark = inside & (buf < 128) & ~is_upper & ~is_digit & ~((buf >= 97) & (buf <= 122))
    columns = {
        "log_words": np.log1p(n),
        "mean_word": _share(word_chars, n),
        "symbol_share": _share(n_symbols, word_chars),
        "dup_line_share": _share(n_dup_lines, n_lines),
        "repeat_share": _share(n_repeat, n),
        "distinct_share": _share(n_distinct, n),
        "upper_share": _share(per_doc(counted(is_upper), w.bounds), word_chars),
        "digit_share": _share(per_doc(counted(is_digit), w.bounds), word_chars),
        "punctuation_share": _share(per_doc(counted(is_mark), w.bounds), word_chars),
        "pipe_share": _share(per_doc(counted(buf == 124), w.bounds), n),
        "long_word_share": _share(np.bincount(doc[length > 14], minlength=n_docs), n),
        "words_per_line": _share(n, n_lines),
        "stop_marks": _share(np.bincount(doc[(last == 46) | (last == 33) | (last == 63)], minlength=n_docs), n),
    }
    return counts, np.stack([np.asarray(columns[f], np.float64) for f in FEATURES], axis=1)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points to itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    start: float = 0.0
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, for rows of FEATURES."""
        if not len(self.roots):
            return np.full(len(x), self.start)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: float = 5.0, monotone: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Logistic boosting on binned columns; ``monotone``: +1, 0 or -1 by column."""
    out = Trees(depth=depth)
    if not len(y) or y.min() == y.max():
        out.start = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out.start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), out.start)
    nodes: list[list] = []  # feature, limit, left, right, value

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, rate * float(np.clip(-gs / (hs + l2), low, high))])
        if level == depth or hs < 2 * least:
            return me
        best = (1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            ok = (hl >= least) & (hs - hl >= least)
            if monotone[j]:
                ok &= monotone[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return me
        j, k, vl, vr = best[1]
        middle, goes = (vl + vr) / 2, binned[rows, j] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
        nodes[me][:2] = [j, float(edges[j][k])]
        nodes[me][2] = grow(rows[goes], level + 1, *bounds[0], g, h)
        nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1], g, h)
        return me

    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        at = np.full(len(y), first)
        f, t, lt, rt, v = (np.array(c) for c in zip(*nodes, strict=True))
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), f[at].astype(int)] <= t[at], lt[at], rt[at]).astype(int)
        margin = margin + v[at]
    f, t, lt, rt, v = zip(*nodes, strict=True)
    out.feature, out.limit, out.left, out.right, out.value = np.array(f, np.int32), np.array(t), np.array(lt, np.int32), np.array(rt, np.int32), np.array(v)
    out.roots = np.array(roots, np.int32)
    return out


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array column ``features``."""

    def make():
        return lambda texts: {"features": list(statistics(texts)[1])}

    return map_texts(docs, make, [T.StructField("features", T.ArrayType(T.DoubleType()))], text)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled documents, those with the least hash of doc_id."""
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # One text for each id, so that repeated ids don't make the sample larger: the one with the least hash.
    h = F.xxhash64("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "__quality").agg(F.min_by("text", F.struct(h, "text")).alias("text"))
    got = features(rows.select("__quality", "text")).select("__quality", "features").toPandas()
    if not len(got):
        return Trees()
    x = np.stack([np.asarray(v, np.float64) for v in got["features"]])
    order = np.lexsort([*x.T[::-1], got["__quality"].to_numpy()])  # the same trees whatever the order of tasks
    return fit(x[order], got["__quality"].to_numpy(np.float64)[order])


def with_quality(docs: DataFrame, model: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with STATS, base_failed, quality_score (0 to 1) and kept; columns of these names are replaced."""

    def make():
        def routine(texts):
            counts, x = statistics(texts)
            failed = base_failed(counts)
            score = 1 / (1 + np.exp(-model.margin(x)))
            return {**counts, "base_failed": failed, "quality_score": score, "kept": ~failed & (score >= least)}

        return routine

    fields = [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_texts(docs, make, fields, text)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return with_quality(docs, model).select("doc_id", *STATS, "base_failed", "kept", "quality_score")
