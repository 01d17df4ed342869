"""Reply trees to training conversations.

Messages name their parents; joins of the message table with itself walk from
every leaf to its root, doubling the distance each time, so a tree of depth d
takes log2(d) joins.  Branches (root-to-leaf paths) are ranked by score inside
their conversation, and each chosen branch is formatted as one text.

Template: ``### role: text</turn>\\n`` per turn.  Inside roles and texts a
backslash goes before every backslash, ``#``, ``<`` and (roles) ``:``, so no
control string can appear in them and removing the backslashes restores them.
The loss mask lists the code-point spans of the assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import materialise

LOSS_ROLE = "assistant"
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(c: Column, more: str = "") -> Column:
    """Backslash before every backslash, ``#``, ``<`` and character of ``more``."""
    for ch in "\\#<" + more:
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def linear_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Messages of conversations kept as numbered turns: each replies to the one
    before.  Turns are ordered by number, role and text, null numbers last, so
    repeated rows are turns of their own."""
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_last("_turn"), F.asc_nulls_first("role"),
                                               F.asc_nulls_first("text"))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("_turn"), F.col(role).alias("role"),
                        F.col(text).alias("text")) \
        .withColumn("node", F.row_number().over(order).cast("long")) \
        .select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                F.lit(0.0).alias("score"))


def branches(messages: DataFrame) -> DataFrame:
    """``(conv, leaf, node, up)``: every node of every root-to-leaf path, ``up``
    steps above the leaf.

    A message whose parent does not exist is a root.  Messages that reply to
    themselves, directly or in a ring, are on no path and left out, as are all
    below them.
    """
    nodes = messages.select(F.coalesce("conv", F.lit(None)).alias("conv"), "node", "parent")
    known = nodes.select("conv", F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    same = F.col("a.conv").eqNullSafe(F.col("b.conv"))
    jump = materialise(
        nodes.alias("a").join(known.alias("b"), same & (F.col("a.parent") == F.col("b.parent")), "left")
        .select("a.conv", "a.node", F.when(F.col("b._known"), F.col("a.parent")).alias("to")).distinct(), "parents")
    parents = jump.where("to is not null").select("conv", F.col("to").alias("node")).distinct()
    path = materialise(
        jump.alias("a").join(parents.alias("b"), same & (F.col("a.node") == F.col("b.node")), "left_anti")
        .select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "leaves")
    rounds, most = 0, max(1, jump.count()).bit_length() + 1
    while rounds < most and jump.where("to is not null").limit(1).count():
        above = path.alias("a").join(jump.alias("b"), same & (F.col("a.node") == F.col("b.node"))) \
            .where("b.to is not null") \
            .select("a.conv", "a.leaf", F.col("b.to").alias("node"), (F.col("a.up") + (1 << rounds)).alias("up"))
        path = materialise(path.unionByName(above), "paths")
        jump = materialise(
            jump.where("to is not null").alias("a")
            .join(jump.alias("b"), same & (F.col("a.to") == F.col("b.node")))
            .select("a.conv", "a.node", "b.to"), "jumps")
        rounds += 1
    endless = jump.where("to is not null").select("conv", F.col("node").alias("leaf")).distinct()
    return path.alias("a").join(endless.alias("b"), same & (F.col("a.leaf") == F.col("b.leaf")), "left_anti")


def format_branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``(conv, leaf, branch, n_turns, formatted, loss_spans)``: each chosen
    branch as one text.

    ``messages`` has ``conv, node, parent, role, text, score``.  Branches are
    ranked by mean score (null scores count as 0), ties by the smaller leaf;
    the ``best`` first are formatted, or all.  Null roles and texts are empty.
    A conversation id may be null; ids of nodes are unique in a conversation.
    """
    path = branches(messages)
    same = F.col("p.conv").eqNullSafe(F.col("m.conv")) & (F.col("p.node") == F.col("m.node"))
    told = path.alias("p").join(messages.alias("m"), same).select(
        "p.conv", "p.leaf", (-F.col("p.up")).alias("at"), F.coalesce("m.role", F.lit("")).alias("role"),
        F.coalesce("m.text", F.lit("")).alias("text"), F.coalesce("m.score", F.lit(0.0)).alias("score"))
    turn = F.struct("at", F.concat(F.lit("### "), escape(F.col("role"), ":"), F.lit(": ")).alias("head"),
                    escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    whole = told.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"),
                                             F.avg("score").alias("score"))
    if best is not None:
        rank = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
        whole = whole.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best)
    else:
        whole = whole.withColumn("branch", F.lit(None).cast("int"))
    return whole.mapInPandas(_write, "conv long, leaf long, branch int, n_turns long, formatted string, "
                                     "loss_spans array<struct<start:long,end:long>>")


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, spans = [], []
        for turns in pdf["turns"]:
            parts, at, mask = [], 0, []
            for t in turns:
                at += len(t["head"])
                if t["loss"]:
                    mask.append({"start": at, "end": at + len(t["body"])})
                parts += [t["head"], t["body"], "</turn>\n"]
                at += len(t["body"]) + 8
            texts.append("".join(parts))
            spans.append(mask)
        yield pd.DataFrame({"conv": pdf["conv"].astype("Int64"), "leaf": pdf["leaf"],
                            "branch": pdf["branch"].astype("Int32"), "n_turns": [len(x) for x in pdf["turns"]],
                            "formatted": texts, "loss_spans": spans})


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    utf = lambda s: s.encode("utf-8", "surrogatepass")
    for pdf in batches:
        rows = []
        for conv, text, spans in zip(pdf["conv"].astype("Int64"), pdf["formatted"], pdf["loss_spans"]):
            turns = parse(text)
            loss = [unescape(text[s["start"]:s["end"]]) for s in spans]
            rows.append((conv, len(turns), hashlib.sha256(utf("".join(f"{r}\n{t}\n" for r, t in turns))).hexdigest(),
                         sum(map(len, loss)), hashlib.sha256(utf("".join(loss))).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                          "formatted_chars"]).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and their loss masks hold, as counts and digests."""
    return formatted.select("conv", "formatted", "loss_spans").mapInPandas(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")
