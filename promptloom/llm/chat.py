"""Chat logs: collapse cumulative snapshots, render what is left.

A service that logs a conversation after every turn leaves snapshots, each a prefix
of the next. Every turn gets a digest of the conversation up to it; a conversation
whose last digest another one has before its own end is a snapshot and goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators.skew import added, find_hot_keys, running
from promptloom.session import materialise

PARTS = 3  # of a prefix's digest, 40 bits each
BLOCK_TURNS = 1000


def chatml(role: Column, text: Column) -> Column:
    """One turn between its markers; null parts are empty."""
    blank = F.lit("")
    return F.concat(
        F.lit("<|im_start|>"),
        F.coalesce(role, blank),
        F.lit("\n"),
        F.coalesce(text, blank),
        F.lit("<|im_end|>\n"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, position`` and ``prefix``, the digest of the turns so far.

    Positions count from 1 in the order of turn, role and text. The digest is a sum of
    hashes of position, role and text, so that it can be continued across tasks: a
    conversation with more turns than one task should take is cut into ranges.
    """
    hot = find_hot_keys(turns, ["conv"])
    order = ["turn", "role", "text"]
    numbered = running(
        turns, ["conv"], order, "position", F.count, F.lit(1), added, hot
    )
    names = [f"p{i}" for i in range(PARTS)]
    for i, name in enumerate(names):
        told = F.xxhash64(
            F.lit(i), "position", "role", "text", F.col("role").isNull(), F.col("text").isNull()
        )
        numbered = running(
            numbered,
            ["conv"],
            order,
            name,
            F.sum,
            F.pmod(told, F.lit(1 << 40)),
            added,
            hot,
        )
    return numbered.withColumn("prefix", F.struct(*names)).drop(*names)


def collapse(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Turns of the maximal conversations: ``conv, turn, role, text, position``.

    A conversation goes if it is the beginning of a longer one; of equal ones that
    with the smallest id stays. Null roles and texts equal each other and nothing
    else. Turns that share a number keep the order of their role and text. Rows
    without a conversation id belong to no conversation and are left out.
    """
    turns = df.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    ).where("conv IS NOT NULL")
    told = materialise(prefixes(turns), "prefixes")
    ends = materialise(
        told.groupBy("conv").agg(
            F.max(F.struct("position", "prefix")).alias("end")
        ).select("conv", "end"),
        "ends",
    )
    # a prefix that someone has before the end
    inner = materialise(
        told.select("conv", F.struct("position", "prefix").alias("end"))
        .join(ends.select("conv", F.col("end.position").alias("last")), "conv")
        .where("end.position < last")
        .select("end")
        .distinct(),
        "inner",
    )
    # one row per end first: all copies of a conversation share it
    leaders = ends.groupBy("end").agg(F.min("conv").alias("conv"))
    maximal = materialise(leaders.join(inner, "end", "left_anti").select("conv"), "maximal")
    return told.join(maximal, "conv", "left_semi").drop("prefix")


def render(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, block, n_turns, rendered``: turns as text, a block of them per row.

    Blocks keep a conversation of any length out of a single row; a usual
    conversation is its block 0, and blocks in order make the whole text.
    """
    piece = F.struct("position", chatml(F.col("role"), F.col("text")).alias("piece"))
    block = F.floor((F.col("position") - 1) / block_turns)
    return (
        turns.groupBy(F.col("conv").alias("conv_id"), block.alias("block"))
        .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select("conv_id", "block", "n_turns", F.array_join("pieces.piece", "").alias("rendered"))
    )
