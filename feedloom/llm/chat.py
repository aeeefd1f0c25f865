"""Chat formatting: reply trees to conversations, one for each chosen root-to-leaf path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import cut, discard

# The template: <|role|>\ntext<|end|>\n for each turn. Neither "<" nor "&" stands in an escaped text, nor "|" or ">" in an escaped role.
_TEXT = (("&", "&amp;"), ("<", "&lt;"))
_ROLE = (*_TEXT, ("|", "&#124;"), (">", "&gt;"))
END = "<|end|>\n"
TURN = re.compile(r"<\|([^|]*)\|>\n([^<]*)<\|end\|>\n")


def escape(text: str, pairs=_TEXT) -> str:
    for plain, coded in pairs:
        text = text.replace(plain, coded)
    return text


def unescape(text: str, pairs=_ROLE) -> str:
    for plain, coded in reversed(pairs):
        text = text.replace(coded, plain)
    return text


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of characters that the loss counts: the escaped texts of role `learn`."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role, _ROLE)}|>\n", escape(text)
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything that render() can't have written is an error."""
    turns, at = [], 0
    while at < len(formatted):
        match = TURN.match(formatted, at)
        if not match:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(match[1]), unescape(match[2], _TEXT)))
        at = match.end()
    return turns


def chain(messages: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: every row replies to the one before it by turn, then role and text."""
    rows = messages.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", place.cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, top_k: int = 1, salts: int = 64) -> DataFrame:
    """(tree, leaf, rank, path_score, node, depth): the nodes of each tree's top_k root-to-leaf paths by mean score.

    messages: tree, node (unique in its tree), parent (null or absent: a root), score (null counts as 0). Self-joins
    double the stretch that each node's pointer spans, carrying sum and length, until all reach their root: as many
    joins as the longest path has bits, each of the nodes that are not at their root yet. Ties go to the smallest leaf. The chosen leaves then walk back over the same
    pointers, longest first, so only chosen paths are written out, each round its own new nodes; a round's pointers are
    deleted when no later round reads them. Joins are on (tree, node), so a tree with a third of
    all rows is dealt out like any other; leaves are ranked within salted parts first. Nodes below a cycle of parents
    have no root and are on no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    keys = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    known = nodes.join(keys, nodes.tree.eqNullSafe(keys.t) & (nodes.parent == keys.n), "left")
    step = cut(known.select("tree", "node", F.col("n").alias("up"), "total", F.lit(1).cast("long").alias("length")), "step")
    on, rooted = step.where("up is not null"), step.where("up is null")
    steps, most, longest = [on], 1, step.count()
    while most <= longest and not on.isEmpty():
        other = on.union(rooted).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("length").alias("length2"))
        joined = on.join(other, on.tree.eqNullSafe(other.t) & (on.up == other.n))
        step = cut(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("length") + F.col("length2")).alias("length")), "step")
        on, rooted = step.where("up is not null"), rooted.union(step.where("up is null"))
        steps.append(on)
        most *= 2
    replied = messages.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = rooted.join(replied, rooted.tree.eqNullSafe(replied.t) & (rooted.node == replied.n), "left_anti")
    leaves = leaves.select("tree", "node", "length", (F.col("total") / F.col("length")).alias("path_score"))
    order = [F.desc("path_score"), F.asc("node")]
    for parts in (["tree", F.pmod(F.xxhash64("node"), F.lit(salts))], ["tree"]):
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col("rank") <= top_k)
    leaves = cut(leaves.select("tree", F.col("node").alias("leaf"), "rank", "path_score", "node", F.col("length").alias("depth")), "leaves")
    walked = leaves
    for k in range(len(steps) - 1, -1, -1):
        if k < len(steps) - 1:
            up = steps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
            higher = walked.join(up, walked.tree.eqNullSafe(up.t) & (walked.node == up.n))
            walked = walked.union(cut(higher.select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")), "walked"))
        discard(steps[k])
    return walked


def format_conversations(messages: DataFrame, top_k: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, path_score, n_turns, formatted, loss_spans): each chosen path as one conversation.

    messages: tree, node, parent, role, text, score (see chain() for linear tables). Turns stand from root to leaf.
    Null roles and texts count as empty; texts are whole, however long; rows that repeat are nodes of their own in
    chain(). loss_spans are the spans of characters (end not included) that hold texts of role `learn`. No rows give none.
    """
    paths = best_paths(messages, top_k)
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, paths.tree.eqNullSafe(texts.t) & (paths.node == texts.n))
    grouped = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    tree = messages.schema["tree"].dataType.simpleString()
    leaf = messages.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in row.as_py()], learn) for row in batch.column("turns")]
            spans = pa.array([[{"start": s, "end": e} for s, e in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch({**{n: batch.column(n) for n in ("tree", "leaf", "rank", "path_score")}, "n_turns": pa.array([len(r) for r in batch.column("turns")], pa.int64()), "formatted": pa.array([m[0] for m in made], pa.string()), "loss_spans": spans})

    return grouped.mapInArrow(run, f"tree {tree}, leaf {leaf}, rank int, path_score double, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")
