"""Answer tables and judge templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.sources.requests import number_rows

CATEGORIES = "text STRING, category STRING"
TEMPLATES = "category STRING, prompt_template STRING, defaults STRUCT<prompt: STRING>"


def read_answers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``request_id, request, response`` of every Parquet answer table, with ``answer_idx``."""
    union = None
    for i, path in enumerate(paths):
        part = spark.read.parquet(path).select(
            "request_id", "request", "response", F.lit(i).alias("answer_idx")
        )
        union = part if union is None else union.unionByName(part)
    return union


def read_answers_csv(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, request, response`` of an exported table, other columns unread.

    The id is the row's position, as the two tables of a comparison have their
    rows in the same order. An empty answer stays empty; the reader itself takes
    even a quoted empty cell as null.
    """
    rows = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return number_rows(
        rows.select("request", F.coalesce("response", F.lit("")).alias("response"))
    )


def read_judge_templates(
    spark: SparkSession, categories: str, templates: str
) -> tuple[DataFrame, DataFrame]:
    """``request, category`` and ``category, prompt, prompt_template``.

    A question or category listed twice is an error before anything is judged.
    """
    asked = spark.read.schema(CATEGORIES).json(categories).select(
        F.col("text").alias("request"), "category"
    )
    told = spark.read.schema(TEMPLATES).json(templates).select(
        "category", F.col("defaults.prompt").alias("prompt"), "prompt_template"
    )
    assert_unique(asked, "request")
    assert_unique(told, "category")
    return asked, told


def assert_unique(df: DataFrame, key: str) -> None:
    double = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if double:
        raise ValueError(f"{key} is listed more than once: {double[0][key]!r}")


def list_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Decode list cells of an exported CSV: column -> array type."""
    return df.withColumns({c: F.from_json(c, t) for c, t in types.items()})
