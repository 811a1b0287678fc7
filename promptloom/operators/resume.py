"""Leave out what an earlier run has finished."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.skew import ROWS_PER_TASK, find_hot_keys, join_spread


def request_digest(df: DataFrame, request: str = "request") -> Column:
    """32 bytes that stand for a request, a text or a list of messages; null for null."""
    value = F.col(request)
    if not isinstance(df.schema[request].dataType, T.StringType):
        value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("r"))))
    return F.unhex(F.sha2(value, 256))


def skip_done(
    requests: DataFrame,
    done: DataFrame,
    row_key: Sequence[str] = ("request_id",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Requests whose text is not in ``done``.

    Matching is by the text's SHA-256, so what is finished is 32 bytes a text, and
    neither side is sorted by texts. Copies of a text within ``requests`` all stay or
    all go; a null request stays. A text that fills much of ``requests`` is spread by
    ``row_key``.
    """
    finished = done.select(request_digest(done).alias("_digest")).distinct()
    keyed = requests.withColumn("_digest", request_digest(requests))
    hot = find_hot_keys(keyed, ["_digest"], rows_per_task)
    left = join_spread(keyed, finished, ["_digest"], "left_anti", row_key, hot)
    return left.drop("_digest")
