"""Language-model scoring: causal self-attention over subword ids, trained in numpy.

Texts are lower-cased (A-Z) and dealt to blocks of about BLOCK bytes by a hash of id and
text, so what a block holds doesn't depend on files, partitions or cores.  Each block is
written once with its vocabulary, word counts and subword ids (of a public vocabulary, so
their number is bounded).  Word counts of all blocks are summed by word hash and return to
their blocks, so no vocabulary is ever collected; they give the unigram base score.

Every subword is predicted from a context window of the WIDTH subwords before it at most
and HALF + 1 at least (where its text has them): windows begin every HALF places, overlap by half, and
score the second half of their places, so each token is scored once.  One layer of masked
attention (one head: its query and key matrices are one product, and so are its value and
output matrices) reads a vector for each subword, and a learned term for each pair of
places.  What it yields predicts the class of the next subword by a softmax, and the
subword inside its class by a Huffman tree whose nodes have learned vectors (a
hierarchical softmax, so probabilities of all ids add up to one).  Classes hold about
equal mass; vectors of subwords begin as those of their class, nodes at the shares of their
sides in all training documents.

Weights are fitted by rounds of parameter averaging over blocks: Adam steps, and Adagrad
steps for the subwords and nodes that are met.  Each round takes another third of the
training windows of every block, and together they take every subword of every training
document once.  Vectors are averaged over the blocks that met them; sums are made in a
fixed order, in groups, before they reach the driver (some 100,000 rows of DIM + 1 numbers
for a vocabulary of 50,000, whatever the input).

Training and scoring of blocks run in the executors' JVMs (``LmKernel.java``, compiled by the
driver and sent to them); ``Attention``, ``train_block`` and ``score_block`` below are the
same in numpy, and are what runs where the JVM has no compiler or vector module.

Cases: null text is empty: one end token; rows without doc_id count as training; repeated
rows count each time; if nothing is in the training part, counts are 0 and the model is
uniform inside classes; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import base64
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jvm
from tidemark.llm.arrow_text import Words, slices, texts_of
from tidemark.llm.store import save

#: Remainder of crc32(doc_id as text) mod FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2
CLASSES, DIM, HALF = 64, 16, 16
WIDTH = 2 * HALF
#: Rounds of averaging, each over one step in so many; half windows in a step.
ROUNDS, BATCH = 3, 256
#: Half windows that are scored at once; probabilities don't depend on it.
AT_ONCE = 1024
#: Bytes of text in a block, about.
BLOCK = 8 << 20
#: Bytes of them whose words are found at once.
SLICE_OF_TEXT = 1 << 19
GROUPS = 64
#: Rows with the same id and text above which they are dealt to different blocks.
REPEATS = 1000
#: Vectors of subwords and nodes that are averaged together, and their rate beside that of the weights.
SLICE, ROW_RATE = 8192, 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_BLOCK_FIELDS = [("doc_id", pa.list_(pa.int64())), ("train", pa.binary()), ("n", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("subs", pa.binary()), ("sub_n", pa.binary()), ("n_train", pa.int64())]
_BLOCK_SCHEMA = "doc_id array<long>, train binary, n binary, tokens binary, hashes binary, counts binary, subs binary, sub_n binary, n_train long"


def sub_type(size: int) -> type:
    """Smallest type for ids of a vocabulary of this size."""
    return np.uint16 if size <= 1 << 16 else np.int32


def make_block(ids: list[int | None], texts: list[bytes], enc, spaced: np.ndarray) -> tuple:
    train = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS != HELD_OUT for i in ids], bool)
    # Some texts at a time: hashes of words don't depend on what stands before them, and the memory stays small.
    parts = [Words(texts[a:b], lower=True) for a, b in slices(texts, SLICE_OF_TEXT)]
    n = np.concatenate([np.diff(w.first) for w in parts]).astype(np.int32)
    hashes, first, index = np.unique(np.concatenate([w.hashes() for w in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(index, np.repeat(train, n), len(hashes)).astype(np.int64)
    of = np.empty(len(first), object)
    begin = np.cumsum([0, *(len(w.start) for w in parts)])
    for w, x, y in zip(parts, begin[:-1], begin[1:], strict=True):
        at, low = np.flatnonzero((first >= x) & (first < y)), w.buf.tobytes()
        of[at] = [low[a:b] for a, b in zip(w.start[first[at] - x].tolist(), w.end[first[at] - x].tolist(), strict=True)]
    words = of.tolist()
    subs = np.array(enc.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")) if words else [], np.int32)
    begin = np.flatnonzero(spaced[subs])
    sub_n = np.diff(np.append(begin, len(subs)))
    if len(sub_n) != len(words):  # a word that the pattern reads in another way next to a space: one by one
        each = [enc.encode_ordinary(" " + x.decode("utf-8", "replace")) for x in words]
        sub_n, subs = np.array([len(e) for e in each]), np.array([i for e in each for i in e], np.int32)
    return ids, train.tobytes(), n.tobytes(), index.astype(np.int32).tobytes(), hashes.tobytes(), counts.tobytes(), subs.astype(sub_type(len(spaced))).tobytes(), sub_n.astype(np.int32).tobytes(), int(n[train].sum() + train.sum())


def dealt(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text, h): rows with the number of their block."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    size = own.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK))
    # Rows that are the same many times over would make one block too large: they are dealt anew by number.
    many = save(own.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS))
    rows = own.withColumn("k", F.lit(0).cast("long"))
    if many.take(1):
        same = own["doc_id"].eqNullSafe(many["doc_id"]) & (own["h"] == many["h"])
        hot = many.join(own.join(F.broadcast(many), same, "left_semi").dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("i"), "text", F.col("h").alias("g")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
        rows = own.join(many, same, "left_anti").withColumn("k", F.lit(0).cast("long")).unionByName(hot.select("doc_id", "text", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")))
    return rows.select(F.pmod(F.xxhash64("doc_id", "h", "k"), F.lit(n)).alias("block"), "doc_id", "text", "h").repartition(min(n, _tasks(own.sparkSession, n)), "block").sortWithinPartitions("block", "doc_id", "h")


def _tasks(spark: SparkSession, blocks: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4)


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """One row for each block of documents."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        spaced = np.zeros(max(ranks.values()) + 1, bool)
        spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True
        now, ids, texts = None, [], []

        def flush():
            row = make_block(ids, texts, enc, spaced)
            columns = [pa.array([v], t) for v, (_, t) in zip(row, _BLOCK_FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([now], pa.int64())], names=[k for k, _ in _BLOCK_FIELDS] + ["block"])

        for batch in batches:
            for block, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                if block != now and ids:
                    yield flush()
                    ids, texts = [], []
                now = block
                ids.append(i)
                texts.append(t)
        if ids:
            yield flush()

    return save(dealt(docs).select("block", "doc_id", "text").mapInArrow(run, _BLOCK_SCHEMA + ", block long"))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
            for k in range(0, len(h), 50_000):
                x, y = h[k : k + 50_000], c[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), pa.array(np.arange(k, k + len(x))), pa.array(x), pa.array(y)], names=["block", "i", "h", "c"])


def word_counts(table: DataFrame) -> tuple[DataFrame, int]:
    """((block, known), number of distinct training words): counts of each block's words over all training documents, as i << 40 | count."""
    rows = table.select("block", "hashes", "counts").mapInArrow(_vocabulary, "block long, i long, h long, c long")
    # A word has one row in each block, so no key has more rows than there are blocks (about 120 a GB of text): nothing to salt.
    sums = save(rows.groupBy("h").agg(F.sum("c").alias("all")))
    both = rows.join(sums, "h")
    packed = F.shiftleft(F.col("i"), 40) + F.col("all")
    return save(both.groupBy("block").agg(F.collect_list(packed).alias("known"))), sums.where(F.col("all") > 0).count()


def subword_counts(table: DataFrame, size: int) -> np.ndarray:
    """Counts of every subword id, and of ends, over the training documents; ids are those of the vocabulary file."""

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for subs, sub_n, counts, train in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                weight = np.repeat(np.frombuffer(counts, np.int64), np.frombuffer(sub_n, np.int32))
                total[:size] += np.bincount(np.frombuffer(subs, sub_type(size)), weight, size).astype(np.int64)
                total[size] += np.frombuffer(train, bool).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = table.select("subs", "sub_n", "counts", "train").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def classes_of(counts: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """Class of every id; the last id is the end and has class 0 alone, the others are dealt by mass from the most frequent."""
    order = np.argsort(-counts[:-1], kind="stable")
    smooth = counts.astype(np.float64) + 1
    mass = np.cumsum(smooth[order])
    which = np.zeros(len(counts), np.int64)
    which[order] = np.minimum((mass - smooth[order]) / mass[-1] * (n - 1), n - 2).astype(np.int64) + 1
    return which


class Codes:
    """Class of every id and its way through the Huffman tree of its class: ``node`` and ``sign`` from ``first[id]`` to ``first[id + 1]``.

    ``bias`` of a node is the log odds of its sides by counts.
    """

    def __init__(self, counts: np.ndarray):
        self.which = classes_of(counts)
        up: dict[int, tuple[int, int]] = {}  # of ids, and of nodes as -1 - node
        bias: list[float] = []
        members = np.argsort(self.which, kind="stable")
        for ids in np.split(members, np.flatnonzero(np.diff(self.which[members])) + 1):
            heap = [(int(counts[i]) + 1, int(i)) for i in ids]
            heapq.heapify(heap)
            while len(heap) > 1:
                (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
                up[a], up[b] = (len(bias), 1), (len(bias), -1)
                heapq.heappush(heap, (m + n, -1 - len(bias)))
                bias.append(math.log(m / n))
        node, sign, first = [], [], [0]
        for i in range(len(counts)):
            at = i
            while at in up:
                k, side = up[at]
                node.append(k)
                sign.append(side)
                at = -1 - k
            first.append(len(node))
        self.node, self.sign, self.first = np.array(node, np.int32), np.array(sign, np.float32), np.array(first, np.int64)
        self.size = np.diff(self.first)
        self.bias = np.array(bias, np.float32)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all ids (the last two: end and start of a document) and nodes (the last column: their odds), as they begin."""
        rng = np.random.Generator(np.random.PCG64(11))
        of_class = (rng.standard_normal((CLASSES + 1, DIM)) * 0.5).astype(np.float32)
        nodes = np.zeros((len(self.bias), DIM + 1), np.float32)
        nodes[:, DIM] = self.bias
        return of_class[np.append(self.which, CLASSES)], nodes

    def length(self, ids: np.ndarray) -> np.ndarray:
        return self.size.take(ids)


def summed(keys: np.ndarray, columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys (below ``size``), the sums of their columns, and how often each occurs."""
    there = np.zeros(size, bool)
    there[keys] = True
    met = np.flatnonzero(there)
    place = np.empty(size, np.int64)
    place[met] = np.arange(len(met))
    at = place.take(keys)
    sums = np.empty((len(met), len(columns)), np.float32)
    for k, c in enumerate(columns):
        sums[:, k] = np.bincount(at, c, len(met))
    return met, sums, np.bincount(at, minlength=len(met)).astype(np.float32)


def _windows(x: np.ndarray) -> np.ndarray:
    """Half windows (n + 1, HALF, DIM) as n windows that overlap, without a copy."""
    x = x.reshape(-1, HALF, DIM)
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x) - 1, WIDTH, DIM), (a, b, c), writeable=False)


def _turned(x: np.ndarray) -> np.ndarray:
    """The same windows as (n, DIM, WIDTH), copied, since products with turned views are several times slower."""
    x = x.reshape(-1, HALF, DIM).transpose(0, 2, 1)
    out = np.empty((len(x) - 1, DIM, WIDTH), np.float32)
    out[:, :, :HALF] = x[:-1]
    out[:, :, HALF:] = x[1:]
    return out


def _merged(parts: np.ndarray) -> np.ndarray:
    """Windows (n, WIDTH, DIM) added up to the half windows they consist of."""
    out = np.empty((len(parts) + 1, HALF, DIM), np.float32)
    out[:-1] = parts[:, :HALF]
    out[-1] = 0
    out[1:] += parts[:, HALF:]
    return out.reshape(-1, DIM)


def _bounded(z: np.ndarray) -> np.ndarray:
    """Cut to 60 either way in place; nearly always there is nothing to cut, and two reads are cheaper."""
    if z.size and (z.max() > 60 or z.min() < -60):
        np.clip(z, -60, 60, out=z)
    return z


class Attention:
    """One layer of causal self-attention over windows of subword ids.

    A step takes n half windows that follow one another and the one before them:
    ``seen`` (n + 1, HALF) are the ids before each place, ``fresh`` says which of the n
    begin a document and so don't look back.
    """

    SHAPES = {"qk": (DIM, DIM), "v": (DIM, DIM), "place": (HALF, WIDTH), "out": (DIM, CLASSES), "bias": (CLASSES,)}
    _mask = (np.arange(WIDTH) <= np.arange(HALF)[:, None] + HALF).astype(np.float32)
    _scale = np.float32(DIM**-0.5)

    def __init__(self, codes: Codes, flat: np.ndarray | None = None, vectors: np.ndarray | None = None, nodes: np.ndarray | None = None):
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(7))
            flat = np.concatenate([(rng.standard_normal(math.prod(s)) * (0.0 if k in ("bias", "place") else 0.25)).astype(np.float32) for k, s in self.SHAPES.items()])
        if vectors is None:
            vectors, nodes = codes.start()
        self.codes, self.flat, self.vectors, self.nodes = codes, flat.astype(np.float32).copy(), vectors.copy(), nodes.copy()
        self.p, at = {}, 0
        for k, s in self.SHAPES.items():
            self.p[k] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)

    def packed(self) -> bytes:
        c = self.codes
        sizes = np.array([len(c.which), len(c.node), len(c.bias)])
        return b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in ((sizes, "<i4"), (c.which, "<i4"), (c.first, "<i4"), (c.node, "<i4"), (c.sign, "<f4"), (self.flat, "<f4"), (self.vectors, "<f4"), (self.nodes, "<f4")))

    def hidden(self, seen: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Vectors (n * HALF, DIM) from which the next subword is read."""
        p = self.p
        x = self.vectors.take(seen.ravel(), 0)
        q, v = (x[HALF:] @ (p["qk"] * self._scale)).reshape(-1, HALF, DIM), x @ p["v"]
        a = q @ _turned(x)
        a += p["place"]
        np.exp(_bounded(a), out=a)
        a *= self._mask
        a[fresh, :, :HALF] = 0
        a *= (1 / (a @ np.ones(WIDTH, np.float32)))[:, :, None]
        h = (a @ _windows(v)).reshape(-1, DIM)
        h += x[HALF:]
        return h, (x, q, v, a)

    def classes(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural log probability of the target class, exponentials of all, their sums)."""
        z = h @ self.p["out"]
        z += self.p["bias"]
        got = _bounded(z).ravel().take(np.arange(0, z.size, CLASSES) + target)
        np.exp(z, out=z)
        total = z @ np.ones(CLASSES, np.float32)
        return got - np.log(total), z, total

    def inside(self, h: np.ndarray, target: np.ndarray, scale: np.ndarray | None = None) -> tuple:
        """Natural log probability of the target ids inside their classes.

        With ``scale`` (the weight of each place) also the gradients: (dh, nodes met, their
        slopes, how often).  Places are taken by the length of their ways, so that each step down
        the trees is one block of rows; slopes are kept by columns.
        """
        codes = self.codes
        size = codes.length(target) if scale is None else np.where(scale > 0, codes.length(target), 0)
        order = np.argsort((255 - size).astype(np.uint8), kind="stable")
        more = len(size) - np.cumsum(np.bincount(size))  # places with more than k steps
        h, at, got = h.take(order, 0), codes.first.take(target.take(order)), np.zeros(len(target), np.float32)
        if scale is not None:
            scale, across, dh, done = scale.take(order), np.ascontiguousarray(h.T), np.zeros_like(h), 0
            keys, slopes = np.empty(int(size.sum()), np.int64), np.empty((DIM + 1, int(size.sum())), np.float32)
        for m in more[:-1]:
            at = at[:m]
            node, sign = codes.node.take(at), codes.sign.take(at)
            at += 1
            w = self.nodes.take(node, 0)
            odds = np.einsum("ij,ij->i", h[:m], w[:, :DIM])
            odds += w[:, DIM]
            odds *= -sign
            np.exp(_bounded(odds), out=odds)
            more_odds = odds + 1
            got[:m] -= np.log(more_odds)
            if scale is not None:
                ds = odds
                ds /= more_odds
                ds *= scale[:m]
                ds *= -sign
                keys[done : done + m] = node
                np.multiply(across[:, :m], ds, out=slopes[:DIM, done : done + m])
                slopes[DIM, done : done + m] = ds
                done += m
                w *= ds[:, None]
                dh[:m] += w[:, :DIM]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        out = got.take(place)
        if scale is None:
            return (out,)
        return out, dh.take(place, 0), *summed(keys, list(slopes), len(self.nodes))

    def log_probability(self, seen: np.ndarray, fresh: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the target id at every place."""
        h, _ = self.hidden(seen, fresh)
        target = target.ravel()
        return self.classes(h, self.codes.which.take(target))[0] + self.inside(h, target)[0]

    def gradients(self, seen: np.ndarray, fresh: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray, tuple, tuple]:
        """(loss, gradient of flat, those of vectors, those of nodes); the last two as (rows met, slopes, how often)."""
        p, target, live = self.p, target.ravel(), live.ravel()
        h, (x, q, v, a) = self.hidden(seen, fresh)
        cls = self.codes.which.take(target)
        scale = (live / np.float32(max(1, int(live.sum())))).astype(np.float32)
        got, z, total = self.classes(h, cls)
        within, dh, *nodes = self.inside(h, target, scale)
        loss = -float(((got + within) * scale).sum(dtype=np.float64))
        # The slopes of classes are z by rows of share; the narrow factors take the share.
        share = scale / total
        z.ravel()[np.arange(0, z.size, CLASSES) + cls] -= total
        g = {"out": (h * share[:, None]).T @ z, "bias": share @ z}
        dz = z @ p["out"].T
        dz *= share[:, None]
        dh += dz
        do = dh.reshape(-1, HALF, DIM)
        da = do @ _turned(v)
        # What a row of da gets by its weights is what dh gets by what the attention yielded.
        da -= np.einsum("ij,ij->i", dh, h - x[HALF:]).reshape(-1, HALF, 1)
        da *= a
        dv = _merged(a.transpose(0, 2, 1) @ do)
        dq = (da @ _windows(x)).reshape(-1, DIM)
        dx = _merged(da.transpose(0, 2, 1) @ q)
        g["place"] = np.ones(len(da), np.float32) @ da.reshape(len(da), -1)
        g["qk"], g["v"] = x[HALF:].T @ dq * self._scale, x.T @ dv
        dx += dv @ p["v"].T
        dx[HALF:] += dh
        dx[HALF:] += dq @ (p["qk"] * self._scale).T
        vectors = summed(seen.ravel(), list(np.ascontiguousarray(dx.T)), len(self.vectors))
        return loss, np.concatenate([np.asarray(g[k], np.float32).ravel() for k in self.SHAPES]), vectors, tuple(nodes)


class Steps:
    """State of the optimiser while one block is trained."""

    def __init__(self, model: Attention):
        self.model, self.n = model, 0
        self.mean, self.square = np.zeros_like(model.flat), np.zeros_like(model.flat)
        self.sums = [np.zeros((len(t), 2), np.float32) for t in (model.vectors, model.nodes)]  # times met, mean squares of slopes

    def take(self, flat: np.ndarray, tables: tuple, rate: float) -> None:
        self.n += 1
        self.mean += 0.1 * (flat - self.mean)
        self.square += 0.01 * (flat * flat - self.square)
        self.model.flat -= rate * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-8)
        for table, sums, (rows, slope, often) in zip((self.model.vectors, self.model.nodes), self.sums, tables, strict=True):
            own = sums.take(rows, 0)
            own[:, 0] += often
            own[:, 1] += np.einsum("ij,ij->i", slope, slope) / np.float32(slope.shape[1])
            sums[rows] = own
            slope *= (np.float32(-rate * ROW_RATE) / (np.sqrt(own[:, 1]) + np.float32(1e-8)))[:, None]
            slope += table.take(rows, 0)
            table[rows] = slope


def sequences(row: dict, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subword ids with an end after each document, document of each, first place of each document)."""
    n, tokens = np.frombuffer(row["n"], np.int32), np.frombuffer(row["tokens"], np.int32)
    subs, sub_n = np.frombuffer(row["subs"], sub_type(len(which) - 1)), np.frombuffer(row["sub_n"], np.int32)
    begin = np.cumsum(sub_n) - sub_n
    size = sub_n[tokens]
    doc = np.repeat(np.arange(len(n)), n)
    per_doc = np.bincount(doc, size, len(n)).astype(np.int64)
    at = np.cumsum(size) - size
    ids = subs[np.repeat(begin[tokens] - at, size) + np.arange(size.sum())] if len(tokens) else np.zeros(0, np.int64)
    ends = np.cumsum(per_doc + 1) - 1
    out = np.full(int((per_doc + 1).sum()), len(which) - 1, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = ids
    return out, np.repeat(np.arange(len(n)), per_doc + 1), ends - per_doc


class Halves:
    """The half windows of a block's documents: ``start``, whether ``fresh``, and ``live`` places."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, top: int):
        self.ids = ids
        self.seen = np.concatenate([[top], ids[:-1]])[: len(ids)]
        self.seen[first] = top  # stands for the start of a document
        end = np.append(first[1:], len(ids))
        count = -(-(end - first) // HALF)
        doc = np.repeat(np.arange(len(first)), count)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        self.start, self.end, self.doc, self.fresh = first[doc] + number * HALF, end[doc], doc, number == 0

    def step(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seen, fresh, target, live, places) of half windows i to j - 1."""
        before = self.start[i - 1 : i] if i else self.start[:1]
        at = np.concatenate([before, self.start[i:j]])[:, None] + np.arange(HALF)
        live = at[1:] < self.end[i:j, None]
        at = np.minimum(at, len(self.ids) - 1)
        return self.seen[at], self.fresh[i:j], self.ids[at[1:]], live, at[1:]


def score_block(model: Attention, row: dict, step: int = AT_ONCE) -> np.ndarray:
    """log10 probability of every document of a block."""
    ids, doc, first = sequences(row, model.codes.which)
    halves = Halves(ids, first, len(model.codes.which))
    got = np.empty(len(ids), np.float64)
    for k in range(0, len(halves.start), step):
        seen, fresh, target, live, at = halves.step(k, k + step)
        got[at[live]] = model.log_probability(seen, fresh, target)[live.ravel()]
    return np.bincount(doc, got / math.log(10), len(first))


def order(block: int, steps: np.ndarray) -> np.ndarray:
    """The steps of a block as they are taken: by a hash, which ``LmKernel.mixed`` has too."""
    x = np.uint64(block * 0x9E3779B97F4A7C15 % (1 << 64)) + steps.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return steps[np.argsort((x ^ (x >> np.uint64(31))).view(np.int64), kind="stable")]


def train_block(steps: Steps, row: dict, turn: int, rate: float) -> int:
    """Takes the steps of this round, one in ROUNDS, over the training documents of a block; returns how many."""
    model = steps.model
    ids, doc, first = sequences(row, model.codes.which)
    train = np.frombuffer(row["train"], bool)
    keep = train[doc]
    ids, first = ids[keep], (np.cumsum(keep) - 1)[first[train]]
    halves = Halves(ids, first, len(model.codes.which))
    size = min(BATCH, max(16, len(halves.start) // 64))  # a small table takes as many steps as a block does at least
    mine = np.arange(0, len(halves.start), size)
    mine = mine[(np.arange(len(mine)) + row["block"]) % ROUNDS == turn]
    for k in order(row["block"], mine // size) * size:
        seen, fresh, target, live, _ = halves.step(k, k + size)
        _, flat, *tables = model.gradients(seen, fresh, target, live)
        steps.take(flat, tuple(tables), rate)
    return len(mine)


#: In the order of the arguments of ``LmKernel``.
_SEQ = ("n", "tokens", "subs", "sub_n", "train")
_SUMS = "slice long, g long, block long, at binary, sum binary, n long"


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def _met(steps: Steps, before: Attention) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows met, how often, their moves times that) of vectors, then nodes."""
    for now, was, sums in zip((steps.model.vectors, steps.model.nodes), (before.vectors, before.nodes), steps.sums, strict=True):
        at = np.flatnonzero(sums[:, 0])
        yield at, sums[at, 0], (now[at] - was[at]) * sums[at, :1]


def _read(out: bytes) -> tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """What ``LmKernel.train`` returns: (steps, weights, the same of vectors and nodes as _met)."""
    at = 4 + 4 * sum(math.prod(s) for s in Attention.SHAPES.values())
    n, flat, tables = int(np.frombuffer(out, "<i4", 1)[0]), np.frombuffer(out[4:at], "<f4"), []
    for width in (DIM, DIM + 1):
        met = int(np.frombuffer(out, "<i4", 1, at)[0])
        rows, often, moves = np.frombuffer(out, "<i4", met, at + 4), np.frombuffer(out, "<f4", met, at + 4 + 4 * met), np.frombuffer(out, "<f4", met * width, at + 4 + 8 * met)
        tables.append((rows, often, moves.reshape(met, width)))
        at += 4 + 4 * met * (2 + width)
    return n, flat, tables


def _moved(block: int, n: int, flat: np.ndarray, tables, n_vectors: int) -> pa.RecordBatch:
    """Rows of _SUMS: slice 0 has the weights, the others the moves of SLICE vectors, then nodes, and how often they were met."""
    out = [(0, np.zeros(1, np.int32).tobytes(), (flat.astype(np.float64) * n).tobytes(), n)]
    for base, (at, often, moves) in zip((0, -(-n_vectors // SLICE)), tables, strict=True):
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // SLICE)) + 1) if len(at) else []:
            out.append((1 + base + int(at[part[0]]) // SLICE, at[part].astype(np.int32).tobytes(), np.concatenate([moves[part], often[part, None]], axis=1).astype(np.float32).tobytes(), 0))
    columns = [pa.array([k for k, *_ in out]), pa.array([block % GROUPS] * len(out)), pa.array([block] * len(out)), pa.array([a for _, a, *_ in out], pa.binary()), pa.array([x for *_, x, _ in out], pa.binary()), pa.array([w for *_, w in out])]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "g", "block", "at", "sum", "n"])


def _add(pdf):
    """Sums of one slice, in the order of blocks."""
    pdf = pdf.sort_values("block")
    at = np.concatenate([np.frombuffer(b, np.int32) for b in pdf["at"]])
    values = np.concatenate([np.frombuffer(b, np.float64 if pdf["slice"].iloc[0] == 0 else np.float32).reshape(len(np.frombuffer(a, np.int32)), -1) for a, b in zip(pdf["at"], pdf["sum"], strict=True)])
    order = np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return pdf.iloc[:1].assign(at=[at[begin].tobytes()], sum=[np.add.reduceat(values, begin, axis=0).tobytes()], n=int(pdf["n"].sum()))


def _beside(rows: DataFrame, model: Attention) -> DataFrame:
    """Rows with the bytes of the model, as ``LmKernel`` reads them; their number is bounded by the vocabulary."""
    spark = rows.sparkSession
    return rows.crossJoin(F.broadcast(spark.createDataFrame([(bytearray(model.packed()),)], "model binary")))


def fit(table: DataFrame, codes: Codes) -> Attention:
    """Parameter averaging over all blocks."""
    model = Attention(codes)
    spark = table.sparkSession
    ready = jvm.ready(spark)
    for turn in range(ROUNDS):
        rate, top = 0.02 / (turn + 1), len(model.vectors)
        if ready:

            def parts(batches, top=top):
                for batch in batches:
                    for row in _rows(batch):
                        n, flat, tables = _read(row["out"])
                        if n:
                            yield _moved(row["block"], n, flat, tables, top)

            args = [F.col(c) for c in ("model", *_SEQ, "block")] + [F.lit(x) for x in (turn, ROUNDS, BATCH, rate, ROW_RATE)]
            moved = _beside(table.select("block", *_SEQ), model).select("block", F.call_udf(jvm.TRAIN, *args).alias("out")).mapInArrow(parts, _SUMS)
        else:
            shared = spark.sparkContext.broadcast((codes, model.flat, model.vectors, model.nodes))

            def run(batches, shared=shared, turn=turn, rate=rate, top=top):
                start = Attention(*shared.value)
                for batch in batches:
                    for row in _rows(batch):
                        steps = Steps(Attention(*shared.value))
                        n = train_block(steps, row, turn, rate)
                        if n:
                            yield _moved(row["block"], n, steps.model.flat, list(_met(steps, start)), top)

            moved = table.select("block", *_SEQ).mapInArrow(run, _SUMS)
        got = moved.groupBy("slice", "g").applyInPandas(_add, _SUMS).groupBy("slice").applyInPandas(_add, _SUMS).collect()
        tops = -(-len(model.vectors) // SLICE)
        for r in sorted(got, key=lambda r: r["slice"]):
            if r["slice"] == 0:
                flat = (np.frombuffer(r["sum"], np.float64) / r["n"]).astype(np.float32)
                model = Attention(codes, flat, model.vectors, model.nodes)
                continue
            into = model.vectors if r["slice"] <= tops else model.nodes
            moved = np.frombuffer(r["sum"], np.float32).reshape(-1, into.shape[1] + 1)
            into[np.frombuffer(r["at"], np.int32)] += moved[:, :-1] / moved[:, -1:]
    return model


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    table = blocks(docs, path or default_path())
    known, distinct = word_counts(table)
    n_train = int(table.agg(F.sum("n_train")).first()[0] or 0)
    with open(path or default_path(), "rb") as f:
        size = 1 + max(int(line.split()[1]) for line in f)
    counts = subword_counts(table, size)
    n_docs_train = int(counts[-1])
    distinct += n_docs_train > 0
    model = fit(table, Codes(counts))
    ready = jvm.ready(spark)
    shared = None if ready else spark.sparkContext.broadcast((model.codes, model.flat, model.vectors, model.nodes))

    def run(batches):
        model = None if ready else Attention(*shared.value)
        floor = math.log10(n_train + distinct + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names if k != "known"}
                packed = batch.column("known")[i]
                n = np.frombuffer(row["n"], np.int32)
                tokens = np.frombuffer(row["tokens"], np.int32)
                seen = np.zeros(len(np.frombuffer(row["sub_n"], np.int32)), np.int64)
                if packed.is_valid:
                    x = packed.values.to_numpy().astype(np.int64)
                    seen[x >> 40] = x & ((1 << 40) - 1)
                doc = np.repeat(np.arange(len(n)), n)
                c = seen[tokens]
                base = np.bincount(doc, np.log10(c + 1), len(n)) + math.log10(n_docs_train + 1) - (n + 1) * floor
                n_known = np.bincount(doc, c > 0, len(n)).astype(np.int64) + (n_docs_train > 0)
                train = np.frombuffer(row["train"], bool)
                score = np.frombuffer(row["scores"], "<f8") / math.log(10) if ready else score_block(model, row)
                columns = [pa.array(row["doc_id"], pa.int64()), pa.array(~train), pa.array(n.astype(np.int64) + 1), pa.array(n_known), pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = table.select("block", "doc_id", *_SEQ).join(known.select("block", "known"), "block", "left").drop("block")
    if ready:
        scored = F.call_udf(jvm.SCORE, *[F.col(c) for c in ("model", *_SEQ[:4])])
        both = _beside(both, model).select("doc_id", "n", "tokens", "sub_n", "train", "known", scored.alias("scores"))
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
