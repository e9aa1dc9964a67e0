"""N-gram Jaccard join by MinHash banding.

A document's set holds the hashes of its windows of ``n`` words (lower case,
cut at everything that is neither letter nor digit; all words as one window if
there are fewer).  Signatures are cut into bands whose number and height follow
from the target recall at the threshold.  Rows are shuffled on band hashes; each
bucket links its members to its least member, and components of these stars are
the sets of documents to be compared.  Inside a component all pairs are verified
on the full sets, in blocks of bounded size, by counts of common windows: what
leaves a block is one row per document (its number of links and the least
document it is connected with), never the pairs.  So a group of any size is
compared whole, and no task holds more than two blocks.  Rows of hot keys (a band,
class or text that very many share) are joined where they are.

Equal texts are one node from the start.  Result per row of the input: class_id
(least doc_id of all documents connected by links or equal texts), rep_id (least
doc_id of its text), n_links (number of different texts it is linked with).

Cases: texts without words have no links, equal ones still form a class; null
text counts as empty; rows with null doc_id keep their class, whose id is null
only if all its ids are; repeated rows stay, each with the same result; an empty
table gives an empty result; columns named as the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import SPACES, Words, map_texts, mix, ngram_hashes
from tidemark.llm.graph import components, join_apart
from tidemark.llm.store import save

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Documents, and windows, that one block holds at most.
BLOCK_DOCS, BLOCK_WINDOWS = 1024, 2_000_000
SALTS = 64
#: Bits of the filter that keeps documents without candidates from the second pass, at most.
FILTER_BITS = 27

_other = np.ones(256, bool)
_other[48:58] = _other[65:91] = _other[97:123] = _other[128:] = False
NOT_WORD = _other


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the highest bands that reach ``recall`` at ``threshold`` with at most ``most`` hash functions."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall")
    return best


def windows(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of all texts, and the text that each belongs to."""
    w = Words(texts, lower=True, separators=NOT_WORD)
    words, doc = w.hashes(), w.doc_of_words()
    count = np.diff(w.first)
    grams = ngram_hashes(words, n)
    ok = doc[n - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    grams, at = grams[ok], doc[: len(ok)][ok]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [mix(np.array([ngram_hashes(words[w.first[i] : w.first[i] + count[i]], int(count[i]))[0] ^ np.uint64(count[i])], np.uint64))[0] for i in short]
        grams, at = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    return grams, at


def band_hashes(texts: list[bytes], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes by text (rows of zeros without words), and numbers of windows."""
    grams, doc = windows(texts, n)
    size = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), bands), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out, size
    begin = (np.cumsum(size) - size)[full]
    low = (grams >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(20240229))
    times, plus = rng.integers(1, 1 << 32, (2, bands * rows), np.uint64).astype(np.uint32)
    times |= np.uint32(1)
    value = np.empty_like(low)
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(low ^ plus[k], times[k], out=value)
            value ^= value >> np.uint32(15)
            h = mix(h * np.uint64(31) + np.minimum.reduceat(value, begin).astype(np.uint64))
        out[full, b] = h
    return out, size


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of common members of each set of ``a`` with each of ``b`` (``a`` itself if None)."""
    sets = a if b is None else [*a, *b]
    size = np.array([len(s) for s in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[member]
    row, member = row[keep], column[member[keep]]
    n_a, n_b = len(a), len(a if b is None else b)
    out = np.zeros((n_a, n_b), np.float32)
    step = 4096
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    cuts = np.searchsorted(member, np.arange(0, int(shared.sum()) + step, step))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        tile = np.zeros((len(sets), step), np.float32)
        tile[row[i:j], member[i:j] - k * step] = 1
        out += tile[:n_a] @ (tile if b is None else tile[n_a:]).T
    return np.rint(out).astype(np.int64)


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    common = _common(a, b)
    n_a, n_b = np.array([len(s) for s in a]), np.array([len(s) for s in (a if b is None else b)])
    union = n_a[:, None] + n_b[None, :] - common
    linked = common >= threshold * union - 1e-9
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def _roots(n: int, linked: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One task: the pairs inside each component's block, or those between two of its blocks."""
    out = []
    for (_, x, y), g in pdf.groupby(["comp", "x", "y"], sort=False):
        g = g.sort_values("node")
        node = g["node"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in g["grams"]]
        if x == y:
            linked = _links(sets, None, threshold)
        else:
            left = (g["block"] == x).to_numpy()
            at = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            n = int(left.sum())
            linked = np.zeros((len(g), len(g)), bool)
            if 0 < n < len(g):
                part = _links([sets[i] for i in at[:n]], [sets[i] for i in at[n:]], threshold)
                linked[np.ix_(at[:n], at[n:])] = part
                linked |= linked.T
        out.append(pd.DataFrame({"node": node, "root": node[_roots(len(g), linked)], "n": linked.sum(axis=1)}))
    return pd.concat(out)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with rep_id, class_id, n_links and __class (the class as a hash, never null)."""
    bands, rows = bands_for(threshold, recall)
    results = ("__node", "__class", "rep_id", "class_id", "n_links")
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    src = src.withColumn("__node", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))

    def make():
        def routine(texts):
            h, size = band_hashes(texts, n, bands, rows)
            return {"bands": [x if s else [] for x, s in zip(h.view(np.int64), size, strict=True)], "n_windows": size}

        return routine

    signed = map_texts(src.select(F.col("__node").alias("node"), F.col(text).alias("text")), make, [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n_windows", T.LongType())])
    signed = save(signed.select("node", "bands", "n_windows").dropDuplicates(["node"]))

    banded = signed.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count("*").alias("n")).where("head < tail").select("band", "head", "n")
    stars = join_apart(banded, heads, "band", "n", bands * signed.count()).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    found = save(components(stars))

    weights = found.join(signed.select("node", "n_windows"), "node")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("windows") / BLOCK_WINDOWS)).cast("int")
    comps = save(weights.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n_windows").alias("windows")).select("root", "docs", "windows", blocks.alias("blocks")))
    held = comps.where("blocks = 1").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("windows")).first()
    groups = max(1, math.ceil((held["docs"] or 0) / BLOCK_DOCS), math.ceil((held["windows"] or 0) / BLOCK_WINDOWS))
    # Members of one large component never meet by its root alone: they are dealt to SALTS places first.
    large = comps.where("blocks > 1").select("root", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = found.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(large, ["root", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "node", F.col("root").alias("comp"), "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(groups)))).otherwise(F.concat_ws(":", F.hex("root"), F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
    )

    bits = candidate_bits(found.select("node"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, mask = shared.value, np.uint64(8 * len(shared.value) - 1)
        for pdf in batches:
            h = np.array([int.from_bytes(x[:8], "big") for x in pdf["node"]], np.uint64) & mask
            pdf = pdf[(mine[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                grams, doc = windows([(t or "").encode() for t in part["text"]], n)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pd.DataFrame({"node": part["node"], "grams": [np.unique(grams[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    texts = src.select(F.col("__node").alias("node"), F.col(text).cast("string").alias("text"))
    grams = texts.mapInPandas(sets, "node binary, grams binary").dropDuplicates(["node"])
    checked = placed.join(grams, "node").groupBy("task").applyInPandas(lambda pdf: _verify(pdf, threshold), "node binary, root binary, n long")
    checked = save(checked)
    links = checked.groupBy("node").agg(F.sum("n").alias("n_links"))
    roots = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))

    ids = src.groupBy("__node").agg(F.min(doc_id).alias("rep_id"), F.count("*").alias("rows"))
    nodes = ids.join(links, ids["__node"] == links["node"], "left").drop("node").join(roots, ids["__node"] == roots["node"], "left")
    nodes = save(nodes.select("__node", "rep_id", "rows", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "__node").alias("root")))
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("rows").alias("rows")).first()
    least = nodes.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.count("*").alias("n"))
    by_node = save(join_apart(nodes, least, "root", "n", size["nodes"]).select("__node", F.col("root").alias("__class"), "rep_id", "class_id", "n_links", "rows"))
    return join_apart(src, by_node, "__node", "rows", size["rows"] or 0).drop("__node")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of ``docs``: of the rows with the least doc_id the one with the least text (and of equal ones any)."""
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    marked = classes(own).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("rep_id").eqNullSafe(F.col("class_id")))
    # What is left is one row for a class unless rows repeat; classes without any doc_id are told apart by their text.
    return marked.dropDuplicates(["class_id", "__class"]).select(*[F.col(f"__own{i}").alias(c) for i, c in enumerate(names)])


def bits_of(places: DataFrame, width: int) -> np.ndarray:
    """A bitmap of 2**width bits (15 at least) with the bits of ``places`` (at) set."""
    rows = places.groupBy(F.expr("at div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits")).collect()
    out = np.zeros(1 << (width - 3), np.uint8)
    for r in rows:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidate_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap by the first bytes of the node: at most 2**FILTER_BITS bits, whatever the number of nodes."""
    n = max(1, nodes.count())
    width = min(FILTER_BITS, max(15, math.ceil(math.log2(16 * n))))
    at = F.conv(F.substring(F.hex("node"), 1, 16), 16, 10).cast("decimal(20,0)") % (1 << width)
    return bits_of(nodes.select(at.cast("long").alias("at")), width)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "rep_id", "n_links")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep FROM documents GROUP BY 1),
w AS (SELECT rep, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM t),
s AS (SELECT DISTINCT rep, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r(x, y) AS (SELECT rep, rep FROM t UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1),
links AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, class_id, rep AS rep_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN classes ON classes.x = rep LEFT JOIN links ON links.x = rep
"""
