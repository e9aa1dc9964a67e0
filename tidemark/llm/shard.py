"""Sharding by K-d tree partitioning.

Equal texts form one point whose weight is the bytes of all its copies; its
coordinates are metadata (source, language, size of one copy, least doc_id).
Starting from all points, every cell is split at the weighted median along its
widest dimension, until each leaf stands for one shard, that is until leaves reach
the target bytes.  Medians are found for all cells of a level at once by distributed
histograms that are refined, twelve bits a pass, down to the single point, so ties
in a dimension are broken by the point's hash and no rows are sorted or collected:
a pass brings cells x 4096 sums to the driver.

A point heavier than ``HEAVY`` of a shard would make a median coarse.  Such points
(their number is bounded by shards / HEAVY) are placed first, largest first, on the
lighter side of a cell, and the median of the others makes up for them.  A point of
more than a whole shard cannot stay together if sizes are to be equal: only then are
its copies dealt to several shards.

Law: ``bytes``: shards differ by less than HEAVY of a shard or the largest single text.

Cases: null text is empty (one byte with its separator); null metadata sorts first;
repeated rows are copies; rows without doc_id are placed like others; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import save

HEAVY = 1 / 64
PASS_BITS = 12
#: Rows of one numbering task, about.
SLOT_ROWS = 100_000
DIMENSIONS = ("source", "lang", "size", "doc_id")


def _ordinal(c: Column, kind: str, skip: int = 0) -> Column:
    """A non-negative 32-bit coordinate that keeps the order of the values (strings: of their four bytes after the first ``skip``)."""
    if kind == "string":
        at = F.conv(F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 1 + 2 * skip, 8), 8, "0"), 16, 10).cast("long")
    else:
        at = F.greatest(F.lit(0), F.least(F.lit((1 << 32) - 1), c.cast("double"))).cast("long")
    return F.coalesce(at, F.lit(0).cast("long"))


def points(docs: DataFrame) -> DataFrame:
    """(key, weight, copies, d0..d3, tie) of every different text; docs has key, size and the metadata."""
    own = {"source": F.min("source"), "lang": F.min("lang"), "size": F.min("size"), "doc_id": F.min("doc_id")}
    kinds = dict(docs.dtypes)
    names = [d for d in DIMENSIONS if kinds[d] == "string"]
    # What the least and the greatest value begin with, all values begin with: it says nothing about order.
    ends = docs.agg(*[f(d).alias(f"{n}_{d}") for d in names for n, f in (("a", F.min), ("b", F.max))]).first() if names else {}
    skip = {d: len(os.path.commonprefix([(ends[f"a_{d}"] or "").encode(), (ends[f"b_{d}"] or "").encode()])) for d in names}
    agg = docs.groupBy("key").agg(F.sum("size").alias("weight"), F.count("*").alias("copies"), *[own[d].alias(f"v_{d}") for d in DIMENSIONS])
    return agg.select("key", "weight", "copies", *[_ordinal(F.col(f"v_{d}"), kinds[d], skip.get(d, 0)).alias(f"d{i}") for i, d in enumerate(DIMENSIONS)], F.shiftrightunsigned(F.xxhash64("key"), 33).alias("tie"))


class Cell:
    def __init__(self, first: int, shards: int, widths: list[float], light: int, heavy: list[tuple[bytes, int]]):
        self.first, self.shards, self.light, self.heavy = first, shards, light, heavy
        self.widest = max(range(len(widths)), key=lambda i: (widths[i], -i))
        self.weight = light + sum(w for _, w in heavy)

    def part(self) -> int:
        """Shards of the left side."""
        return self.shards // 2

    def share_heavy(self) -> tuple[list, list, int]:
        """Heavy points of the left and the right side, and the weight that light points shall add on the left."""
        goal = [self.weight * self.part() / self.shards, self.weight * (self.shards - self.part()) / self.shards]
        sides: tuple[list, list] = ([], [])
        room = list(goal)
        for key, w in sorted(self.heavy, key=lambda x: (-x[1], x[0])):
            k = int(room[1] > room[0])
            sides[k].append((key, w))
            room[k] -= w
        return sides[0], sides[1], max(0, min(self.light, round(room[0])))


def _by_cell(cells: list[Cell], of) -> Column:
    """Value of ``of(cell)`` for the row's cell."""
    keys = [F.lit(x) for c in cells for x in (c.first, of(c))]
    return F.element_at(F.create_map(*keys), F.col("cell"))


def _cuts(light: DataFrame, cells: list[Cell], goals: dict[int, int]) -> dict[int, int]:
    """For each cell the 63-bit key below or at which its points go left, so that their weight comes nearest to the goal."""
    pos = light.select("cell", "weight", F.col("pos"))
    prefix = {c.first: 0 for c in cells}  # bits of the cut that are settled
    below = {c.first: 0 for c in cells}  # weight before the settled prefix
    bits = 63
    done: dict[int, int] = {}
    while bits > 0 and len(done) < len(cells):
        step = min(PASS_BITS, bits)
        open_ = [c for c in cells if c.first not in done]
        want = F.element_at(F.create_map(*[F.lit(x) for c in open_ for x in (c.first, prefix[c.first])]), F.col("cell"))
        at = pos.where(F.col("cell").isin([c.first for c in open_])).where(F.shiftright("pos", bits) == want)
        rows = at.groupBy("cell", F.shiftright("pos", bits - step).bitwiseAND((1 << step) - 1).alias("bin")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        for c in open_:
            mine, acc = sorted((r["bin"], r["w"], r["n"]) for r in rows if r["cell"] == c.first), below[c.first]
            goal, chosen = goals[c.first], None
            for b, w, n in mine:
                if acc + w >= goal:
                    chosen = (b, w, n)
                    break
                acc += w
            if chosen is None:  # the goal lies beyond all points
                done[c.first] = (1 << 63) - 1
                continue
            b, w, n = chosen
            prefix[c.first] = prefix[c.first] << step | b
            below[c.first] = acc
            if n == 1 or bits == step:  # one point: it goes where it leaves the smaller error
                low = prefix[c.first] << (bits - step)
                done[c.first] = (low + (1 << (bits - step)) - 1) if acc + w - goal <= goal - acc else low - 1
        bits -= step
    return done


def assign(pts: DataFrame, shards: int) -> tuple[DataFrame, list[tuple[bytes, int, int]]]:
    """(key, shard) of light points, and (key, first shard, shards) of the heavy ones, of which there are at most shards / HEAVY."""
    total = int(pts.agg(F.sum("weight")).first()[0] or 0)
    if not total:
        return pts.select("key", F.lit(0).alias("shard")), []
    limit = max(1, math.ceil(total * HEAVY / shards))
    heavy = [(bytes(r["key"]), int(r["weight"])) for r in pts.where(F.col("weight") > limit).select("key", "weight").collect()]
    placed: list[tuple[bytes, int, int]] = []
    free = shards
    leaf = total / shards
    giants = sorted((h for h in heavy if h[1] > leaf), key=lambda h: (-h[1], h[0]))
    loose = {}
    for key, w in giants:  # whole shards of one text; what is left over stays a heavy point
        n = min(free - 1, int(w // leaf))
        if n > 0:
            placed.append((key, free - n, n))
            free -= n
            loose[key] = max(0, w - round(n * leaf))
    rest = [(k, loose.get(k, w)) for k, w in heavy]
    light = pts.where(F.col("weight") <= limit).withColumn("cell", F.lit(0))
    spans = light.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(len(DIMENSIONS)) for n, f in (("a", F.min), ("b", F.max))], F.sum("weight").alias("w")).first()
    whole = [max(1, (spans[f"b{i}"] or 0) - (spans[f"a{i}"] or 0)) for i in range(len(DIMENSIONS))]
    pieces: dict[bytes, list[tuple[int, int]]] = {}
    cells = [Cell(0, free, [1.0 if (spans[f"b{i}"] or 0) > (spans[f"a{i}"] or 0) else 0.0 for i in range(len(DIMENSIONS))], int(spans["w"] or 0), rest)]
    settled: list[Cell] = []
    while cells := [c for c in cells if c.shards > 1 or settled.append(c)]:
        sides = {c.first: c.share_heavy() for c in cells}
        dim = _by_cell(cells, lambda c: c.widest)
        keyed = light.withColumn("pos", F.when(_by_cell(cells, lambda c: c.first).isNotNull(), F.shiftleft(F.element_at(F.array(*[f"d{i}" for i in range(len(DIMENSIONS))]), dim + 1), 31) + F.col("tie")))
        cuts = _cuts(keyed.where("pos is not null"), cells, {c.first: sides[c.first][2] for c in cells})
        right = F.col("pos") > _by_cell(cells, lambda c: F.lit(cuts[c.first]))
        light = save(keyed.withColumn("cell", F.when(F.col("pos").isNotNull() & right, F.col("cell") + _by_cell(cells, lambda c: c.part())).otherwise(F.col("cell"))).drop("pos"))
        stats = {r["cell"]: r for r in light.groupBy("cell").agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(len(DIMENSIONS)) for n, f in (("a", F.min), ("b", F.max))], F.sum("weight").alias("w")).collect()}
        after = []
        for c in cells:
            for first, n, own in ((c.first, c.part(), sides[c.first][0]), (c.first + c.part(), c.shards - c.part(), sides[c.first][1])):
                r = stats.get(first)
                widths = [(r[f"b{i}"] - r[f"a{i}"]) / whole[i] if r else 0.0 for i in range(len(DIMENSIONS))]
                after.append(Cell(first, n, widths, int(r["w"]) if r else 0, own))
        cells = after
    for c in settled:
        for key, _ in c.heavy:
            pieces.setdefault(key, []).append((c.first, 1))
    out = []
    for key, first, n in placed:
        out.append((key, first, n))
    for key, runs in pieces.items():
        out += [(key, first, n) for first, n in runs]
    return light.select("key", F.col("cell").alias("shard")), out


def shards(docs: DataFrame, n: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; give the number of shards or the bytes that a shard shall reach at most on average."""
    own = docs.select("doc_id", *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")], F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    meta = save(own.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    if n is None:
        total = int(meta.agg(F.sum("size")).first()[0] or 0)
        n = max(1, math.ceil(total / target_bytes))
    pts = save(points(meta))
    light, heavy = assign(pts, n)
    spark = docs.sparkSession
    by_key: dict[bytes, list[tuple[int, int]]] = {}
    for key, first, count in heavy:
        by_key.setdefault(key, []).append((first, count))
    # Copies of a heavy point: one shard, or, for one above a shard, the whole shards first and the rest where it was placed.
    leaf = int(meta.agg(F.sum("size")).first()[0] or 0) / n
    rows = [(bytearray(k), [s for first, count in runs for s in range(first, first + count)]) for k, runs in sorted(by_key.items())]
    # Texts of few bytes but many copies (empty ones, say) would be one hot key of a join: they are told by broadcast too.
    crowded = pts.where(F.col("copies") > max(1.0, meta.count() * HEAVY / n)).select("key")  # at most n / HEAVY
    rows += [(bytearray(r["key"]), [r["shard"]]) for r in light.join(F.broadcast(crowded), "key").collect()]
    table = spark.createDataFrame(rows, "key binary, homes array<int>")
    few = F.broadcast(table)  # at most 2 n / HEAVY rows
    of_heavy = meta.join(few, "key")
    single = of_heavy.where(F.size("homes") == 1).withColumn("shard", F.element_at("homes", 1))
    split = of_heavy.where(F.size("homes") > 1)
    if any(len(h) > 1 for _, h in rows):
        # Number the copies of a split point without one task for all: count by hash range first.
        numbered = gapless(split, "key", ["doc_id", "source", "lang"], "copy_no")
        split = numbered.withColumn("shard", F.element_at("homes", F.least(F.floor(F.col("copy_no") * F.col("size") / F.lit(leaf)), F.size("homes") - 1).cast("int") + 1)).drop("copy_no")
    else:
        split = split.withColumn("shard", F.lit(0))
    rest = meta.join(few.select("key"), "key", "left_anti").join(light, "key")
    columns = ["doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")]
    placed = save(rest.select(*columns).unionByName(single.select(*columns)).unionByName(split.select(*columns)))
    return gapless(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")


def gapless(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 0 without gaps in each group.  Groups are cut into parts by a hash of ``order``, parts are numbered apart and shifted by the sizes of those before; rows equal in ``order`` may swap numbers."""
    parts = max(1, math.ceil(df.count() / SLOT_ROWS)) * 4
    cut = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = cut.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce("__before", F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    return cut.withColumn("__i", inside).join(before, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__part", "__i", "__before", "__g", "__p")


def op1_sharding(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    done = shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), n)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
