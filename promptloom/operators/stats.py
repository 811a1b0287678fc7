"""Sizes of requests, outlines and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.messages import last_message
from promptloom.functions.text import count_words

Counter = Callable[[Column], Column]


def naive_stats(df: DataFrame, tokens: Counter = count_words, messages: str = "request") -> DataFrame:
    """Rounds, lengths in characters and token counts of plain answers."""
    asked = last_message(F.col(messages))
    return df.select(
        "request_id",
        F.floor((F.size(messages) - 1) / 2).cast("int").alias("num_history_round"),
        F.length(asked).alias("request_length"),
        F.length("response").alias("response_length"),
        tokens(asked).alias("request_tokens"),
        tokens(F.col("response")).alias("response_tokens"),
    )


def outline_stats(df: DataFrame, tokens: Counter = count_words, messages: str = "request") -> DataFrame:
    """The same for answers by points, with one entry per point in the lists."""
    asked = last_message(F.col(messages))
    return df.select(
        "request_id",
        F.floor((F.size(messages) - 1) / 2).cast("int").alias("num_history_round"),
        F.length(asked).alias("request_length"),
        F.length("outline").alias("outline_length"),
        F.size("points").alias("num_points"),
        F.transform("point_outlines", F.length).alias("point_outline_length"),
        F.transform("contents", F.length).alias("point_response_length"),
        F.length("response").alias("response_length"),
        tokens(asked).alias("request_tokens"),
        tokens(F.col("outline")).alias("outline_tokens"),
        F.transform("point_outlines", tokens).alias("point_outline_tokens"),
        F.transform("contents", tokens).alias("point_response_tokens"),
        tokens(F.col("response")).alias("response_tokens"),
    )


def tokenizer_counter(load: Callable[[], Callable[[str], list]]) -> Counter:
    """A counter from a Python tokenizer, loaded once per worker.

    For plain text columns; inside a list use a native counter.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return F.pandas_udf(count, "int")
