"""Question tables from CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promptloom.session import materialise

REQUEST = "request STRING"
LABELLED = "label INT, request STRING"

# The field that holds the question in each kind of file.
JSONL_SHAPES = {
    "text": ("text STRING", "text"),
    "instruction": ("Instruction STRING", "Instruction"),
    "first_turn": ("conversations ARRAY<STRING>", "get(conversations, 0)"),
}


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", multi_line: bool = True):
    """CSV with doubled quotes. With ``multi_line`` a file is read by one task,
    so write large tables as many files."""
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .schema(schema)
        .csv(path)
    )


def read_requests_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One column of questions, called ``request`` whatever its header says."""
    return read_csv(spark, path, REQUEST, multi_line=multi_line)


def read_router_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``label;request`` with label 0 for plain answers and 1 for outlines."""
    return read_csv(spark, path, LABELLED, sep=";", multi_line=multi_line)


def ingest_jsonl(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Questions from JSON lines; ``shape`` is a key of :data:`JSONL_SHAPES`."""
    schema, field = JSONL_SHAPES[shape]
    return spark.read.schema(schema).json(path).select(F.expr(field).alias("request"))


def first_turns(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """The first text of each conversation in a turn table."""
    return turns.groupBy(conversation).agg(F.min_by(text, turn).alias("request"))


def number_rows(df: DataFrame, name: str = "request_id") -> DataFrame:
    """Add the row's position in its files, counted from 0 in path order.

    ``df`` must come straight from files. Every split numbers its own rows and
    only the splits' row counts, one row per split, are summed up in order.
    """
    marked = materialise(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_mid"),
        ),
        "numbered",
    )
    # part files by their number, which outgrows the digits that their names reserve
    part = F.expr(r"try_cast(regexp_extract(_file, 'part-(\\d+)[^/]*$', 1) AS BIGINT)")
    earlier = Window.orderBy(part, "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        marked.groupBy("_file", "_start")
        .agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        marked.join(splits, ["_file", "_start"])
        .withColumn(name, F.col("_offset") + F.col("_mid") - F.col("_first"))
        .drop("_file", "_start", "_mid", "_first", "_offset")
    )
