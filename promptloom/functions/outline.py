"""Numbered points in an outline text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.bind import bind

# Fixed pattern: a number, a dot, at most one white space, then at least one
# character (which may be a newline) up to the end of the line. (?U) lets \d
# and \s cover all of Unicode.
POINT = r"(?U)(\d+)\.\s?([\s\S][^\n]*)"


def parse_points(outline: Column) -> Column:
    """All ``struct<point, point_outline>`` in order of appearance."""
    return bind(
        outline,
        lambda text: F.zip_with(
            F.regexp_extract_all(text, F.lit(POINT), 1),
            F.regexp_extract_all(text, F.lit(POINT), 2),
            lambda n, t: F.struct(n.alias("point"), t.alias("point_outline")),
        ),
    )


def dedupe_points(points: Column) -> Column:
    """Only the first entry of every point number (``01`` is not ``1``)."""
    return bind(
        points,
        lambda all_points: bind(
            all_points["point"],
            lambda numbers: F.filter(
                all_points, lambda p, i: F.array_position(numbers, p["point"]) == i + 1
            ),
        ),
    )


def full_outline(partial: Column, text: Column) -> Column:
    return F.concat(F.coalesce(partial, F.lit("")), text)
