"""Chat messages and streamed answer snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.functions.text import strip, unescape_code
from promptloom.operators.skew import ROWS_PER_TASK, added, find_hot_keys, join_spread, later_of, running


def history_before_last(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All messages but the last (pending) one of each conversation, in long form.

    No conversation is collected: the last turn is a combined maximum, joined
    back with long conversations spread by turn.
    """
    last = turns.groupBy(conversation).agg(F.max(turn).alias("_last"))
    hot = find_hot_keys(turns, [conversation], rows_per_task)
    joined = join_spread(turns, last, [conversation], "inner", [conversation, turn], hot)
    return joined.where(F.col(turn) < F.col("_last")).drop("_last")


def session_gate(
    events: DataFrame,
    seconds: float,
    ip: str = "ip",
    ts: str = "ts",
    tie: str = "event_id",
    is_load: str = "is_load",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Messages with ``last_load`` and whether the session is ``active``.

    ``events`` holds page loads and messages. A session lasts ``seconds`` from
    the latest load; a message without any load before it is not active.
    """
    loads = F.when(F.col(is_load), F.col(ts))
    gated = running(
        events,
        [ip],
        [ts, tie],
        "last_load",
        F.max,
        loads,
        later_of,
        find_hot_keys(events, [ip], rows_per_task),
    )
    expires = F.unix_micros(F.col("last_load").cast("timestamp")) + int(seconds * 1_000_000)
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    return gated.where(~F.col(is_load)).withColumn("active", F.coalesce(expires >= now, F.lit(False)))


def admit_message(
    text: Column,
    active: Column,
    flagged: Column,
    n_messages: Column,
    turn_limit: int,
    char_limit: int,
) -> tuple[Column, Column]:
    """Decision on a message and the text that goes on (null if refused).

    Tested in this order: empty, inactive session, moderation, turn limit.
    """
    decision = (
        F.when(F.length(text) <= 0, "empty")
        .when(~active, "inactive")
        .when(flagged, "moderation")
        .when(F.floor(n_messages / 2) >= turn_limit, "turn_limit")
        .otherwise("accepted")
    )
    return decision, F.when(decision == "accepted", F.substring(text, 1, char_limit))


def chunk_delta(
    chunks: DataFrame,
    stream: Sequence[str] = ("request_id", "stage", "point_index"),
    seq: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Newly finished words of each cumulative snapshot.

    The last word of a snapshot may be unfinished and is held back until a
    later snapshot or the end of the stream, where ``flush`` has what is left.
    """
    hot = find_hot_keys(chunks, stream, rows_per_task)
    # words are counted and cut by position; no list of words is ever built
    text = F.col("_text")
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    counted = chunks.select(*stream, seq, strip(F.col("text")).alias("_text")).withColumn(
        "_now", spaces
    )
    if hot:
        shown = running(
            counted,
            stream,
            [seq],
            "_pre",
            F.max,
            F.col("_now"),
            later_of,
            hot,
            preceding_only=True,
        )
        last = chunks.groupBy(*stream).agg(F.max(seq).alias("_last"))
        marked = join_spread(shown, last, list(stream), "inner", [*stream, seq], hot)
        marked = marked.withColumn("_ends", F.col(seq) == F.col("_last"))
    else:
        # the longest snapshot before and the end of the stream, in one window
        order = Window.partitionBy(*stream).orderBy(seq)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        marked = counted.withColumns(
            {
                "_pre": F.max("_now").over(before),
                "_ends": F.lead(seq).over(order).isNull(),
            }
        )
    marked = marked.withColumn("_pre", F.coalesce("_pre", F.lit(0)))

    pre, now = F.col("_pre"), F.col("_now")
    # first n words, with the space after them
    cut = lambda n: F.expr(f"if({n} = 0, 0, length(substring_index(_text, ' ', {n})) + 1)")
    delta = F.substring(text, cut("_pre") + 1, cut("_now") - cut("_pre"))
    flush = F.when(pre <= now, F.substring_index(text, " ", -1)).otherwise("")
    return marked.select(
        *stream,
        seq,
        F.when(now > pre, delta).otherwise("").alias("delta"),
        F.when(F.col("_ends"), flush).alias("flush"),
    )


def chunk_final(
    chunks: DataFrame, key: Sequence[str] = ("request_id",), seq: str = "seq"
) -> DataFrame:
    """The last snapshot of each request."""
    rest = [c for c in chunks.columns if c not in key]
    return (
        chunks.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_f"))
        .select(*key, "_f.*")
    )


def chunk_sample(
    chunks: DataFrame,
    every: int = 5,
    key: Sequence[str] = ("request_id",),
    seq: str = "seq",
    model: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What a viewer sees of a stream: every fifth snapshot, an error, the end.

    Snapshots are counted in the order of ``seq``, which may have gaps. Nothing
    follows the first error. The last snapshot of a stream without error is shown (again) without cursor.
    """
    hot = find_hot_keys(chunks, key, rows_per_task)
    bad = F.min(F.when(F.col("error_code") != 0, F.col(seq)))
    if hot:
        ends = chunks.groupBy(*key).agg(bad.alias("_bad"), F.max(seq).alias("_last"))
        chunks = running(chunks, key, [seq], "_nth", F.count, F.lit(1), added, hot)
        joined = join_spread(chunks, ends, list(key), "inner", [*key, seq], hot)
    else:
        whole = Window.partitionBy(*key)
        joined = chunks.withColumns(
            {
                "_nth": F.count(F.lit(1)).over(
                    whole.orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                "_bad": bad.over(whole),
                "_last": F.max(seq).over(whole),
            }
        )
    at, bad = F.col(seq), F.col("_bad")
    text = strip(F.col("text"))
    final = text
    if model:
        final = F.when(F.col(model).contains("vicuna"), unescape_code(text)).otherwise(text)
    views = F.array(
        F.when(
            (F.col("error_code") == 0) & ((F.col("_nth") - 1) % every == 0),
            F.struct(F.lit("partial").alias("kind"), F.concat(text, F.lit("▌")).alias("shown")),
        ),
        F.when(
            at == bad,
            F.struct(
                F.lit("error").alias("kind"),
                F.concat(
                    F.col("text"),
                    F.lit("\n\n(error_code: "),
                    F.col("error_code").cast("string"),
                    F.lit(")"),
                ).alias("shown"),
            ),
        ),
        F.when(
            bad.isNull() & (at == F.col("_last")),
            F.struct(F.lit("final").alias("kind"), final.alias("shown")),
        ),
    )
    return (
        joined.where(bad.isNull() | (at <= bad))
        .select(*key, seq, F.inline(F.filter(views, lambda v: v.isNotNull())))
    )


def side_by_side(
    left: DataFrame,
    right: DataFrame,
    key: str = "request_id",
    seq: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Two streams advanced together: ``key, step, left_text, right_text``.

    The stream that ends first keeps showing its last snapshot. Steps count the
    snapshots of a stream from 0 in the order of ``seq``, which may have gaps.
    """
    both = left.select(key, seq, F.lit(0).alias("_side"), "text").unionByName(
        right.select(key, seq, F.lit(1).alias("_side"), "text")
    )
    hot = find_hot_keys(both, [key], rows_per_task)
    if not hot:
        # all windows and sums below keep this partitioning
        both = both.repartition(key)
    counted = running(both, [key, "_side"], [seq], "_nth", F.count, F.lit(1), added, hot)
    step = (F.col("_nth") - 1).cast("int").alias("step")
    shown = [
        F.max(F.when(F.col("_side") == i, F.struct("text"))).alias(f"_{name}")
        for i, name in enumerate(("left_text", "right_text"))
    ]
    steps = counted.select(key, "_side", "text", step).groupBy(key, "step").agg(*shown)
    # what a stream that has ended showed last: its step is the last one it has
    for i, name in enumerate(("left_text", "right_text")):
        steps = running(
            steps,
            [key],
            ["step"],
            name,
            F.max,
            F.when(F.col(f"_{name}").isNotNull(), F.struct("step", f"_{name}")),
            later_of,
            hot,
        ).withColumn(name, F.col(f"{name}._{name}.text"))
    return steps.drop("_left_text", "_right_text")
