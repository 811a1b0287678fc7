"""Admission of chat messages on a stream of page loads and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.chat import admit_message
from promptloom.operators.skew import ROWS_PER_TASK, find_hot_keys, join_spread

LOADS = "ip LONG, slot LONG, first_load LONG, last_load LONG"


def loads_by_slot(events: DataFrame, length: int) -> DataFrame:
    """First and last page load per ip and slot of ``length`` microseconds."""
    at = F.unix_micros("ts")
    return (
        events.where("is_load")
        .groupBy("ip", F.floor(at / length).cast("long").alias("slot"))
        .agg(F.min(at).alias("first_load"), F.max(at).alias("last_load"))
    )


def gate(
    messages: DataFrame, loads: DataFrame, length: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``active``: a load at most ``length`` microseconds before the message.

    A slot is as long as a session. A load earlier in the message's own slot
    cannot have expired; of the slot before, only the last load may reach that
    far. So two lookups by ip and slot replace any comparison of pairs.
    """
    at = F.unix_micros("ts")
    slot = F.floor(at / length).cast("long")
    own = loads.select("ip", "slot", "first_load")
    before = loads.select("ip", (F.col("slot") + 1).alias("slot"), "last_load")
    found = messages.withColumns({"_at": at, "slot": slot})
    hot = find_hot_keys(found, ["ip", "slot"], rows_per_task)
    found = join_spread(found, own, ["ip", "slot"], "left", ["event_id"], hot)
    found = join_spread(found, before, ["ip", "slot"], "left", ["event_id"], hot)
    opened: Column = F.col("first_load") <= F.col("_at")
    reaches = F.col("last_load") + length >= F.col("_at")
    active = F.coalesce(opened, F.lit(False)) | F.coalesce(reaches, F.lit(False))
    return found.withColumn("active", active).drop("_at", "slot", "first_load", "last_load")


def admit_batch(
    batch: DataFrame,
    carried: DataFrame | None,
    seconds: int,
    delay_seconds: int,
    turn_limit: int,
    char_limit: int,
) -> tuple[DataFrame, DataFrame]:
    """Decisions on the messages of a batch, and the loads to carry on.

    ``carried`` holds the loads of earlier batches by ip and slot. Slots that no
    message up to ``delay_seconds`` late can still look at are dropped, so what
    is carried is bounded by the ips of that time.
    """
    length = seconds * 1_000_000
    loads = loads_by_slot(batch, length)
    if carried is not None:
        loads = (
            loads.unionByName(carried)
            .groupBy("ip", "slot")
            .agg(F.min("first_load").alias("first_load"), F.max("last_load").alias("last_load"))
        )
    gated = gate(batch.where(~F.col("is_load")), loads, length)
    decision, text = admit_message(
        F.col("text"),
        F.col("active"),
        F.col("flagged"),
        F.col("n_messages"),
        turn_limit,
        char_limit,
    )
    decisions = gated.select("event_id", "ip", decision.alias("decision"), text.alias("text"))
    latest = batch.agg(F.max(F.unix_micros("ts")).alias("at")).first()["at"]
    if latest is None:
        return decisions, loads
    oldest = (latest - delay_seconds * 1_000_000) // length - 1
    return decisions, loads.where(F.col("slot") >= oldest)


def _remove(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def admit_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int,
    delay_seconds: int,
    turn_limit: int,
    char_limit: int,
) -> None:
    """Decide on every message of the stream that is there now.

    ``events`` has ``event_id, ip, ts, is_load, text, flagged, n_messages``. A
    batch is decided by plain joins. Its decisions and the loads it carries on
    belong to its number and are overwritten if it is tried again, so every
    message is decided once. Loads are kept for the last two batches only: one that is
    tried again needs those of the batch before it.
    """
    spark = events.sparkSession
    state = f"{checkpoint}/loads"

    def step(batch: DataFrame, batch_id: int) -> None:
        # the batch is read by several steps; a lost part is read again
        batch.persist()
        carried = spark.read.schema(LOADS).parquet(f"{state}/{batch_id - 1}") if batch_id else None
        decisions, loads = admit_batch(
            batch, carried, seconds, delay_seconds, turn_limit, char_limit
        )
        decisions.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        loads.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        batch.unpersist()
        if batch_id >= 2:
            _remove(spark, f"{state}/{batch_id - 2}")

    (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
