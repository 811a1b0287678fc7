"""All models, schedulers and datasets in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.generate import Backend
from promptloom.plans.dump import dump
from promptloom.session import materialise

CELL = "dataset string, model string, scheduler string"


def experiment_grid(
    requests: DataFrame,
    models: Sequence[str],
    schedulers: Sequence[str],
    done: DataFrame | None = None,
) -> DataFrame:
    """Every request once per model and scheduler, without finished cells.

    ``requests`` has a ``dataset`` column; ``done`` lists finished
    ``dataset, model, scheduler``, at most one row per cell.
    """
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(s).alias("scheduler"))
            for m in models
            for s in schedulers
        ]
    )
    grid = requests.select("*", F.inline(cells))
    if done is None:
        return grid
    keys = ["dataset", "model", "scheduler"]
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def run_grid(
    requests: DataFrame,
    datasets: Sequence[str],
    models: Mapping[str, Backend],
    schedulers: Mapping[str, Callable[[DataFrame, Backend], DataFrame]],
    path: str,
    slices: int = 1,
) -> None:
    """Answer ``request_id, request, dataset`` in every cell of the grid, cell by cell.

    A cell is a Spark job over all requests of its dataset, written to a folder of
    its own and then noted as finished in ``<path>-cells``. A run that broke off goes
    on with the cell it was in, after the slices which that cell has committed;
    finished cells are not looked at again. The loop is over the grid, never over rows.
    What ``requests`` is made of is worked out once, for the datasets with cells to do.
    """
    spark = requests.sparkSession
    finished = {tuple(row) for row in finished_cells(spark, path).collect()}
    cells = [(d, m, s) for d in datasets for m in models for s in schedulers]
    open_ = sorted({cell[0] for cell in cells if cell not in finished})
    if not open_:
        return
    requests = materialise(requests.where(F.col("dataset").isin(open_)), "requests")
    for dataset in datasets:
        own = requests.where(F.col("dataset") == dataset).drop("dataset")
        for model, backend in models.items():
            for name, schedule in schedulers.items():
                cell = (dataset, model, name)
                if cell in finished:
                    continue
                dump(own, lambda part: schedule(part, backend), cell_path(path, *cell), slices=slices)
                noted = spark.createDataFrame([cell], CELL).coalesce(1)
                noted.write.mode("append").parquet(f"{path.rstrip('/')}-cells")


def cell_path(path: str, dataset: str, model: str, scheduler: str) -> str:
    named = zip(("dataset", "model", "scheduler"), (dataset, model, scheduler))
    return "/".join([path.rstrip("/"), *[f"{k}={quote(v, safe='')}" for k, v in named]])


def finished_cells(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, model, scheduler`` of the cells that are done: as many rows as cells."""
    try:
        return spark.read.schema(CELL).parquet(f"{path.rstrip('/')}-cells").distinct()
    except AnalysisException as error:
        if error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            return spark.createDataFrame([], CELL)
        raise


def grid_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers of the grid with ``dataset, model, scheduler``."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/dataset=*/model=*/scheduler=*")
