"""Pooling of token vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.bind import bind


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return bind(
        vector,
        lambda v: bind(
            F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)),
            lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)),
        ),
    )


def mean_pool(
    df: DataFrame, by: Sequence[str], vector: str = "embedding", mask: str | None = None
) -> DataFrame:
    """Masked mean of all vectors of a text, then unit length.

    The mean is a built-in vector aggregate: partial sums are built before the
    shuffle, so a text with very many tokens costs one row per input partition.
    A text whose tokens are all masked gets zeros.
    """
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) if mask else F.lit(1.0)
    # a mean without any weight is an error, so masked tokens have next to none
    some = F.greatest(F.col("_w"), F.lit(1e-300))
    pooled = (
        df.select(*by, array_to_vector(vector).alias("_v"), weight.alias("_w"))
        .groupBy(*by)
        .agg(Summarizer.mean(F.col("_v"), some).alias("_m"), F.sum("_w").alias("_total"))
    )
    mean = vector_to_array("_m")
    zeros = F.transform(mean, lambda x: F.lit(0.0))
    shown = F.when(F.col("_total") > 0, l2_normalise(mean)).otherwise(zeros)
    return pooled.select(*by, shown.alias("embedding"))


def token_total(df: DataFrame, tokens: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of unmasked tokens."""
    return df.groupBy(*by).agg(F.sum(F.col(tokens).cast("long")).alias("token_num"))
