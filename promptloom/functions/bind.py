"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression used inside a lambda over an array is otherwise evaluated
    again for every element, also when it stands in a projection below that
    the optimizer merges into this one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
