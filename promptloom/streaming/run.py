"""Running streams: over what is there now, or for as long as they are left running."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from promptloom.session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, not in the executors' heap.

    A stream that is started again goes on with what its checkpoint was made with.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def start_to_parquet(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append to ``path``: all that is available, or with ``every`` (``"10 seconds"``) a
    batch in each such time until the query is stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
    )
    with state_on_disk(stream.sparkSession):
        return writer.start()


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available to ``path`` and stop."""
    start_to_parquet(stream, path, checkpoint).awaitTermination()


def start_batches(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Run any batch plan per micro-batch, once or with ``every`` until stopped.

    Each micro-batch owns a folder that a repeated attempt overwrites, so the
    result holds every batch once however often it was tried.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def drain_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> None:
    """Run any batch plan per micro-batch over everything available and stop."""
    start_batches(stream, transform, path, checkpoint).awaitTermination()


def result_of(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Drain a stream into the shared folder and read the result."""
    path = scratch_path(spark, label)
    drain_to_parquet(stream, path, f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)
