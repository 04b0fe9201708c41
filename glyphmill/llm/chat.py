"""Operator 6: chat formatting with DataFrame functions only.

A table of turns is a forest of reply trees. Root-to-leaf paths are listed by
self-joins on pointers to ancestors, which double their distance in each round, so a
tree of depth d takes log2(d) rounds of small rows; texts join at the end. Branches
are ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import written

OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: The strings that mark something in this or another common template. Inside a text each gets a backslash after its first character.
CONTROL = (OPEN, CLOSE, NEWLINE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    """The text with its backslashes doubled and its control strings broken by one; no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given: in its result a backslash always stands before a character that it protects."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of every node on the path to each leaf; ``up`` is 0 at the leaf.

    nodes: (tree, node, parent), unique by (tree, node). A parent that is null or absent
    makes a root. Leaves whose ancestors run in a circle have no path and are left out.
    """
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    ids = nodes.select("tree", "node")
    jump = written(
        nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("to")).alias("a")
        .join(ids.alias("b"), same("a", "b") & (F.col("a.to") == F.col("b.node")), "left_semi"),
        "chat-jump",
    )
    jumps = []
    rounds = max(1, nodes.count().bit_length() + 1)
    while len(jumps) < rounds and not jump.isEmpty():
        jumps.append(jump)
        step = jump.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a.to") == F.col("b.node")))
        jump = written(step.select("a.tree", "a.node", "b.to"), "chat-jump")
    parents = jumps[0] if jumps else jump
    leaves = ids.alias("a").join(parents.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.to")), "left_anti")
    if len(jumps) == rounds:  # what still has an ancestor so far up is under a circle
        leaves = leaves.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node")), "left_anti")
        jumps = jumps[:-1]
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        above = paths.alias("a").join(jumps[k].alias("b"), same("a", "b") & (F.col("a.node") == F.col("b.node")))
        paths = written(paths.union(above.select("a.tree", "a.leaf", "b.to", F.col("a.up") + (1 << k))), "chat-paths")
    return paths


def format_chat(turns: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, mask) of the chosen root-to-leaf paths of ``turns``.

    turns: (tree, node, parent, role, text, score). A path's score is the mean of its
    nodes' scores (null: 0); rank 1 is the best, equal ones go by leaf. branches: how
    many of each tree to keep, all if None. mask: (start, stop) in code points of each
    assistant text as it stands in ``formatted``. Null roles and texts count as empty.
    """
    turns = written(turns.select("tree", "node", "parent", "role", "text", "score"), "chat-turns")
    paths = reply_paths(turns.select("tree", "node", "parent"))
    same = F.col("p.tree").eqNullSafe(F.col("t.tree")) & (F.col("p.node") == F.col("t.node"))
    scored = paths.alias("p").join(turns.select("tree", "node", "score").alias("t"), same)
    ranks = scored.groupBy("p.tree", "p.leaf").agg(F.avg(F.coalesce("t.score", F.lit(0.0))).alias("score"))
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranks = ranks.where(F.col("rank") <= branches)
        paths = paths.alias("p").join(ranks.alias("r"), F.col("p.tree").eqNullSafe(F.col("r.tree")) & (F.col("p.leaf") == F.col("r.leaf")), "left_semi")
    role, text = F.coalesce("t.role", F.lit("")), escaped(F.coalesce("t.text", F.lit("")))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    pieces = paths.alias("p").join(turns.alias("t"), same).select("p.tree", "p.leaf", "p.up", head.alias("head"), text.alias("body"), (role == "assistant").alias("learn"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("body") + len(CLOSE) + 1
    placed = pieces.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)) + F.char_length("head"))
    turn = F.struct(F.col("at").alias("at"), F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"), F.char_length("body").alias("n"), "learn")
    whole = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t.learn), lambda t: F.struct(t.at.alias("start"), (t.at + t.n).alias("stop")))
    made = whole.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), mask.alias("mask"))
    on = F.col("m.tree").eqNullSafe(F.col("r.tree")) & (F.col("m.leaf") == F.col("r.leaf"))
    return made.alias("m").join(ranks.alias("r"), on).select("m.tree", "m.leaf", "r.rank", "m.formatted", "m.mask")


def parsed(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from what ``format_chat`` wrote."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    role = lambda x: F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), "\n", 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            unescaped(F.replace(role(x), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescaped(F.substring(x, F.lit(len(OPEN) + 2) + F.char_length(role(x)), F.char_length(x))).alias("text"),
        ),
    )


def learned(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(mask, lambda m: unescaped(F.substring(formatted, (m.start + 1).cast("int"), (m.stop - m.start).cast("int"))))


def linear_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations by turn as reply trees of one branch: each turn replies to the one before; equal turns go by role and text."""
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    placed = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select(F.col(conv).alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))
