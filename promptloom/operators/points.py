"""From outlines to one row per point and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import strip


def explode_points(df: DataFrame, points: str = "points") -> DataFrame:
    """One row per point with ``pos``; a row without points stays, with nulls."""
    return df.select(
        *[c for c in df.columns if c != points],
        F.posexplode_outer(points).alias("pos", "_p"),
    ).select(
        *[c for c in df.columns if c != points],
        "pos",
        F.col("_p.point").alias("point"),
        F.col("_p.point_outline").alias("point_outline"),
    )


def assemble(
    points: DataFrame,
    separator: str,
    stripped: bool = False,
    key: str = "request_id",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Contents of every request in point order and joined to one response.

    Input rows are ``key, pos, partial, text``; rows with a null ``pos`` stand
    for requests without points and give an empty response. ``extra`` columns
    come back as lists in the same order. A group is the
    points of one outline, which came out of one row, so it is bounded by one
    model answer however many requests there are.
    """
    text = strip(F.col("text")) if stripped else F.col("text")
    content = F.when(
        F.coalesce(F.col("partial"), F.lit("")) != "", F.concat("partial", F.lit(" "), text)
    ).otherwise(text)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", content.alias("content"), *extra))
    return (
        points.select(key, entry.alias("entry"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select(
            key,
            F.col("entries.content").alias("contents"),
            F.array_join("entries.content", separator).alias("response"),
            *[F.col(f"entries.{c}").alias(c) for c in extra],
        )
    )


def assemble_blank_line(points: DataFrame, key: str = "request_id") -> DataFrame:
    return assemble(points, "\n\n", key=key)


def assemble_newline(points: DataFrame, key: str = "request_id") -> DataFrame:
    return assemble(points, "\n", stripped=True, key=key)
