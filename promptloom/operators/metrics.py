"""Metrics of the router."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion_matrix(
    df: DataFrame,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    labels: Sequence[int] | None = None,
    sample_weight: str | None = None,
    normalize: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Long form ``[by…], y_true, y_pred, value`` with every label pair present.

    The data is reduced to one row per pair seen before anything else happens;
    grid and normalisation work on those. ``labels`` gives order and subset,
    default are all labels seen; ``normalize`` is ``true``, ``pred`` or ``all``,
    and 0/0 is 0. At least one of ``labels`` must occur among the true ones.
    """
    if normalize not in {None, "true", "pred", "all"}:
        raise ValueError(f"unknown normalize {normalize!r}")
    weight = F.col(sample_weight).cast("double") if sample_weight else F.lit(1).cast("double")
    seen = (
        df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
        .agg(F.sum(weight).alias("value"))
    )
    if labels is None:
        # one row per group, holding its distinct classes
        grid = seen.groupBy(*by).agg(
            F.array_distinct(
                F.concat(F.collect_set("y_true"), F.collect_set("y_pred"))
            ).alias("_labels")
        )
    else:
        wanted = list(labels)
        if not wanted:
            raise ValueError("labels must not be empty")
        known = F.max(F.col("y_true").isin(wanted).cast("int")) == 1
        grid = seen.groupBy(*by).agg(
            F.when(known, F.lit(wanted))
            .otherwise(F.raise_error(F.lit("no label occurs among the true ones")))
            .alias("_labels")
        )
    grid = grid.select(*by, "_labels", F.explode("_labels").alias("y_true")).select(
        *by, "y_true", F.explode("_labels").alias("y_pred")
    )
    full = grid.join(seen, [*by, "y_true", "y_pred"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    if normalize is None:
        return full
    over = {"true": [*by, "y_true"], "pred": [*by, "y_pred"], "all": [*by]}[normalize]
    total = F.sum("value").over(Window.partitionBy(*over))
    return full.withColumn("_total", total).select(
        *by,
        "y_true",
        "y_pred",
        F.when(F.col("_total") == 0, 0.0)
        .otherwise(F.col("value") / F.when(F.col("_total") != 0, F.col("_total")))
        .alias("value"),
    )


def multilabel_pairs(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """List-valued predictions as element-wise pairs; lengths must agree."""
    same = F.size(y_true) == F.size(y_pred)
    zipped = F.when(same, F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).otherwise(
        F.raise_error(F.lit("predictions and references differ in length"))
    )
    rest = [c for c in df.columns if c not in {y_true, y_pred}]
    return df.select(*rest, F.explode(zipped).alias("_z")).select(
        *rest, F.col("_z.t").alias(y_true), F.col("_z.p").alias(y_pred)
    )


def router_loss(
    df: DataFrame,
    prob: str = "prob",
    label: str = "label",
    label_smoothing: float = 0.9,
    tversky_ratio: float = 0.75,
    fp_ratio: float = 0.7,
    fn_ratio: float = 0.3,
    by: Sequence[str] = (),
) -> DataFrame:
    """Cross entropy and Tversky loss mixed, in one aggregation.

    ``prob`` is the probability of class 1. Cross entropy uses the labels as
    they are, the Tversky part the labels times ``label_smoothing``. A label that
    was given no probability at all makes the cross entropy infinite.
    """
    p = F.col(prob)
    y = F.col(label) * F.lit(label_smoothing)
    given = F.when(F.col(label) == 1, p).otherwise(1 - p)
    sums = df.groupBy(*by).agg(
        F.sum(F.least(p, y)).alias("both"),
        F.sum(p).alias("p"),
        F.sum(y).alias("y"),
        F.avg(F.when(given <= 0, float("inf")).otherwise(-F.log(given))).alias("ce"),
    )
    both = F.col("both")
    tversky = both / (both + fp_ratio * (F.col("p") - both) + fn_ratio * (F.col("y") - both))
    return sums.select(
        *by,
        F.col("ce").alias("loss_ce"),
        (1 - tversky).alias("loss_tversky"),
        ((1 - tversky_ratio) * F.col("ce") + tversky_ratio * (1 - tversky)).alias("loss"),
    )


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
