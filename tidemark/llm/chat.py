"""Chat formatting of reply trees, in DataFrame operations only.

Messages name their parent; iterative self-joins with doubled steps give every
message its distance from the root and the sum of scores on its way there, so a
tree of depth d takes log2(d) rounds.  Branches (leaves) are ranked by that score
and the chosen ones are enumerated the same way, from the leaf to the root, and
formatted as one conversation each.

Template: ``### <role>: <text>`` and a line with ``</turn>`` for each turn.  In roles
and texts every backslash, ``#``, ``<`` and (in roles) colon or line feed is written
with a backslash before it, so no control string can occur inside; reading back takes
the backslashes off again.

Cases: null text and null role count as empty; a null or unknown parent makes a
root; of messages with the same tree and id only the first by parent, role and text
counts (``linear`` numbers rows itself, so there repeated rows all stay); cycles have no root and give no conversation; ties of branches go to the
smaller leaf; an empty table gives an empty result; extra columns are left out.
A conversation becomes one value of one row, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Saved, save

END = "\n</turn>\n"
ROUNDS = 40
#: Added to the query's conversations: both turns hold control strings.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#<]", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#<:\n]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear(rows: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, score, role, text) of conversations whose rows follow each other by turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def _climb(links: DataFrame) -> DataFrame:
    """(tree, node, depth, total) of every message that a root can be reached from; root: depth 0."""
    up = Saved(links.select("tree", "node", F.col("parent").alias("above"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("score").alias("total")))
    before = None
    for _ in range(ROUNDS):
        # Round k settles the depths from 2**(k-1) to 2**k - 1: after one that settles none, what is open hangs on cycles.
        left = up.df.where("above is not null").count()
        if left in (0, before):
            break
        before = left
        there = up.df.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        open_, done = up.df.where("above is not null"), up.df.where("above is null")
        joined = open_.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select("tree", "node", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        after = Saved(done.unionByName(joined))
        up.drop()
        up = after
    return up.df.where("above is null").drop("above")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node), nodes without an id left out."""
    first = F.min(F.struct(F.col("parent").isNotNull().alias("has"), "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    return messages.where("node is not null").groupBy("tree", "node").agg(first.alias("m")).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): the messages on the ``branches`` best root-to-leaf paths of each tree."""
    links = save(messages.select("tree", "node", "parent", "score"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    links = links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.when(F.col("n").isNotNull(), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    links = save(links)
    nodes = _climb(links)
    inner = links.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    # Members of the chosen paths: each round appends the ancestors 2**k steps above those known so far.
    members = Saved(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", "depth"))
    jump = Saved(links.select("tree", "node", F.col("parent").alias("above")))
    deepest, step = members.df.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        to = jump.df.where("above is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        more = members.df.join(to, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", F.col("above").alias("node"), (F.col("depth") - step).alias("depth"))
        grown = Saved(members.df.unionByName(more))
        twice = to.alias("x").join(to.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("above").alias("above2")), F.col("t").eqNullSafe(F.col("t2")) & (F.col("above") == F.col("n2"))).select(F.col("t").alias("tree"), F.col("n").alias("node"), F.col("above2").alias("above"))
        doubled = Saved(twice)
        members.drop()
        jump.drop()
        members, jump, step = grown, doubled, 2 * step
    jump.drop()
    return members.df


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one row per chosen path; loss_spans are [start, end) code points of assistant texts as written."""
    messages = save(distinct_messages(messages))
    on = save(paths(messages, branches))
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = on.join(texts, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("n"))).select("tree", "leaf", "rank", "depth", F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    # The end of each body is a running sum over the same partitions as the group's, so there is one shuffle.
    so_far = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("head") + F.length("body") + len(END)).over(so_far) - len(END))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "loss", "end"))).alias("turns"))
    return turns.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct((t.end - F.length(t.body)).alias("start"), t.end.alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) that the formatted conversation holds."""
    pieces = F.filter(F.split(formatted, r"\n</turn>\n"), lambda p: p != "")
    head = r"(?s)^### ((?:[^\\:]|\\.)*): "
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    done = conversations(linear(rows.unionByName(extra)))
    read = done.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), all_turns AS (
  SELECT conv_id, count(*) AS n,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(regexp_replace(role, '[\\#<:\n]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g')) + 6 + 9) AS chars
  FROM rows GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM all_turns
"""
