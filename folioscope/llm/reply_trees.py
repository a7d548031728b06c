"""Chat formatting of reply trees with DataFrame operations alone.

Replies form trees by parent id. Self-joins that double the distance each round
enumerate every root-to-leaf path in as many rounds as the depth has binary
digits; each tree's paths are ranked by score and the chosen ones formatted as
conversations with a reversible escape and a loss mask.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize

#: The template's control strings. Texts hold none of them once ``<`` and ``[`` are escaped.
START, END = "<|im_start|>", "<|im_end|>"
#: Escapes in the order they apply; undoing goes backwards. Line ends are escaped in roles alone.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
LEARNT_ROLE = "assistant"


def escape(text: Column, pairs=ESCAPES) -> Column:
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return functools.reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """``(leaf, node, height)`` for every node on the path from a root to each leaf; ``height`` counts from the leaf.

    ``nodes`` has ``id`` (unique) and ``parent`` (null at roots). A reply to an
    absent parent is a root. Replies on or below a cycle reach no root and have no path.
    """
    here = nodes.select(F.col("id").alias("parent"))
    jump = nodes.select("id", "parent").where("parent is not null").join(here, "parent", "left_semi")
    jump = materialize(jump.select(F.col("id").alias("node"), F.col("parent").alias("up")), "jumps")
    jumps, longest = [jump], 2 * max(1, nodes.count())
    while not jump.isEmpty() and 1 << len(jumps) <= longest:
        higher = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        jump = materialize(jump.join(higher, "up").select("node", F.col("next").alias("up")), "jumps")
        jumps.append(jump)
    # whoever has ancestors farther away than there are nodes is on or below a cycle
    endless = jumps.pop()
    leaves = nodes.select(F.col("id").alias("leaf")).join(jumps[0].select(F.col("up").alias("leaf")) if jumps else endless.select(F.col("up").alias("leaf")), "leaf", "left_anti")
    leaves = leaves.join(endless.select(F.col("node").alias("leaf")), "leaf", "left_anti")
    paths = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).alias("height"))
    for k, jump in enumerate(jumps):
        farther = paths.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height"))
        paths = materialize(paths.unionByName(farther), "paths")
    return paths


def format_trees(nodes: DataFrame, branches: int | None = 1, learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """One formatted conversation for each chosen root-to-leaf path.

    ``nodes``: ``id`` (unique), ``parent``, ``role``, ``text``, ``score``; null role,
    text and score count as empty and 0. Paths of a tree are ranked by mean score,
    then by leaf id; ``branches`` of them stay (None: all). Returns ``root``, ``leaf``,
    ``branch``, ``formatted`` and ``loss``, an array of ``(start, stop)`` in code
    points over the texts of ``learnt_role``. An empty table gives no rows.
    """
    nodes = nodes.select("id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    paths = tree_paths(nodes)
    scored = paths.join(nodes.select(F.col("id").alias("node"), "score"), "node")
    ranked = scored.groupBy("leaf").agg(F.max_by("node", "height").alias("root"), F.avg("score").alias("mean"))
    ranked = ranked.withColumn("branch", F.expr("row_number() over (partition by root order by mean desc, leaf)"))
    chosen = ranked if branches is None else ranked.where(F.col("branch") <= branches)
    turns = paths.join(chosen.select("leaf", "root", "branch"), "leaf").join(nodes.select(F.col("id").alias("node"), "role", "text"), "node")
    marked = turns.select(
        "leaf", "root", "branch",
        F.struct(
            (-F.col("height")).alias("place"),
            F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body"),
            (F.col("role") == learnt_role).alias("learnt"),
        ).alias("turn"),
    )
    grouped = marked.groupBy("leaf").agg(F.first("root").alias("root"), F.first("branch").alias("branch"), F.array_sort(F.collect_list("turn")).alias("turns"))
    tail = END + "\n"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))

    def mask(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["head"])
        stop = start + F.length(turn["body"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct((stop + len(tail)).alias("at"), F.when(turn["learnt"], F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"))

    return grouped.select(
        "root", "leaf", "branch",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", begin, mask, lambda s: s["loss"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of ``(role, text)``, unescaped."""
    parts = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each turn answers the one before.

    Equal turn numbers go by role, then text (nulls as empty); rows of a null
    ``conv_id`` form one conversation. Longer texts score higher.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.expr("row_number() over (partition by conv_id order by turn, role, text)")
    named = c.select("conv_id", "role", "text", at.alias("at"))
    return named.select(
        F.struct("conv_id", "at").alias("id"),
        F.when(F.col("at") > 1, F.struct("conv_id", (F.col("at") - 1).alias("at"))).alias("parent"),
        "role", "text", F.length("text").alias("score"),
    )


def sample_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both roles say control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format all conversations and conversation -1, and digest what the output holds."""
    both = conversations.select("conv_id", "turn", "role", "text").unionByName(sample_conversation(conversations.sparkSession))
    out = format_trees(conversation_nodes(both))
    read = out.select(
        F.col("root.conv_id").alias("conv_id"),
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learnt"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows in SQL; the template's marks make the difference between text and format.
ORACLE = """
WITH both_parts AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    length('<|im_start|>') + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&#10;')) + 1
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length('<|im_end|>') + 1 AS chars
  FROM both_parts
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
