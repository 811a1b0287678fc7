"""Chat log: one JSON object per answer, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    tstamp DOUBLE, type STRING, model STRING,
    gen_params STRUCT<temperature: DOUBLE, top_p: DOUBLE, max_new_tokens: INT>,
    start DOUBLE, finish DOUBLE,
    state STRUCT<conv_id: STRING, model_name: STRING, messages: ARRAY<ARRAY<STRING>>>,
    ip STRING
"""


def with_date(log: DataFrame) -> DataFrame:
    """The UTC day an answer finished."""
    days = F.floor(F.col("finish") / 86400).cast("int")
    return log.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"))


def write_chat_log(log: DataFrame, path: str) -> None:
    with_date(log).write.mode("append").partitionBy("date").json(path)


def stream_chat_log(log: DataFrame, path: str, checkpoint: str):
    """The same for a stream of finished answers."""
    return (
        with_date(log)
        .writeStream.partitionBy("date")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", date STRING").json(path)
