"""Connected components by alternating large and small stars, and joins that keep hot keys apart, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Saved


#: A key is hot if it has more rows than this, and more than one in HOT_SHARE of all: so there are HOT_SHARE hot keys at most.
HOT, HOT_SHARE = 256, 100_000


def join_apart(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key) on ``key``; rows of hot keys are not shuffled.

    ``count`` names the column of ``keyed`` with the number of rows of its key in ``rows``,
    ``total`` is the number of all rows.  Rows of ``keyed`` whose key is hot are fewer than
    HOT_SHARE whatever the input, and are broadcast; the others meet in a shuffle.  Rows
    without a partner, and null keys, go.
    """
    most = max(HOT, total // HOT_SHARE)
    own = [F.col(f"`{c}`") for c in rows.columns]
    others = [c for c in keyed.columns if c not in (key, count)]
    mark = "__hot"
    while any(c.lower().startswith(mark) for c in rows.columns):
        mark += "_"
    hot = keyed.where(F.col(count) > most).select(F.col(key).alias(mark), *[F.col(c).alias(f"{mark}{i}") for i, c in enumerate(others)])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(mark), "left")
    apart = marked.where(F.col(mark).isNotNull()).select(*own, *[F.col(f"{mark}{i}").alias(c) for i, c in enumerate(others)])
    shuffled = marked.where(F.col(mark).isNull()).select(*own).join(keyed.drop(count), key)
    return apart.unionByName(shuffled.select(*own, *others))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.union(e.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    return join_apart(both.where("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_apart(down, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Minima are combined before they are shuffled, and a hub's edges meet them where
    they are.  Each round is written to the shared folder and the one before it is
    dropped.  Raises if ``rounds`` do not suffice (they follow the logarithm of the
    longest path).
    """
    now = Saved(edges.where("a <> b").select("a", "b").distinct())
    seen, total = None, now.df.count()
    for _ in range(rounds):
        # Stars never have more edges than what they are made of.
        after = Saved(_small_star(_large_star(now.df, total).where("a <> b").distinct(), total).where("a <> b").distinct())
        now.drop()
        now = after
        # A table of stars stays as it is: compare its rows by number and by the sum of their hashes.
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.xxhash64("b", "a") % (1 << 30))).first()
        if mark == seen:
            break
        seen, total = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
