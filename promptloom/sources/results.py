"""Result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ("dataset", "model", "scheduler")


def write_results(
    df: DataFrame, path: str, overwrite: bool = False, replace: bool = False
) -> None:
    """Parquet by ``dataset, model, scheduler``, as far as the columns exist.

    Appending keeps what is there (use :func:`~promptloom.operators.resume.skip_done`
    first); overwriting replaces the partitions that occur in ``df`` and no others, and
    ``replace`` everything.
    """
    by = [c for c in PARTITIONS if c in df.columns]
    writer = df.write.partitionBy(*by) if by else df.write
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    elif overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def csv_cells(df: DataFrame) -> DataFrame:
    """Columns in name order, all text; everything but strings as JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str):
        kind = kinds[name]
        if isinstance(kind, T.StringType):
            return F.col(name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(name).alias(name)
        return F.col(name).cast("string").alias(name)

    return df.select(*[cell(c) for c in sorted(df.columns)])


def export_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Doubled-quote CSV with a header, for other tools."""
    (
        csv_cells(df)
        .write.mode("overwrite" if overwrite else "append")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_predictions(
    df: DataFrame, path: str, order: str = "request_id", prediction: str = "y_pred"
) -> None:
    """One class per line in ``order``, over the part files in name order."""
    df.orderBy(order).select(F.col(prediction).cast("string")).write.text(path)
