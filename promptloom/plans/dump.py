"""Answering a whole request table into a result table, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.messages import last_message
from promptloom.operators.generate import never_fails
from promptloom.operators.resume import skip_done
from promptloom.session import materialise
from promptloom.sources.results import write_results


def dump(
    requests: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    path: str,
    overwrite: bool = False,
    slices: int = 1,
) -> None:
    """Answer ``request_id, request`` with ``run`` and write the results to ``path``.

    Without ``overwrite`` requests already answered there are left out; with it
    the first slice replaces all that is there. The work is committed in
    ``slices``, so that a run that breaks off loses the calls of one slice and a
    new run goes on after the last. All copies of a request text are in one slice,
    hence either all done or all to do.
    A request whose call failed, or one of whose points failed, gets no row in
    ``path``, so the next run asks again; what this run failed at is in
    ``<path>-failed``.
    """
    done = None if overwrite else _answered(requests, path)
    failures = f"{path.rstrip('/')}-failed"
    for number in range(slices):
        own = F.pmod(F.xxhash64("request"), F.lit(slices)) == number
        part = requests.where(own)
        if done is not None:
            same = done.schema["request"].dataType == requests.schema["request"].dataType
            part = skip_done(part, done.where(own) if same else done)
        answered = run(part).withColumn("request", last_message(F.col("request")))
        if "error" in answered.columns:
            if not never_fails(answered):
                answered = materialise(answered, "answered")
            bad = answered.where("error IS NOT NULL")
            bad.write.mode("overwrite" if number == 0 else "append").parquet(failures)
            answered = answered.where("error IS NULL")
        write_results(answered, path, replace=overwrite and number == 0)


def _answered(requests: DataFrame, path: str) -> DataFrame | None:
    try:
        there = requests.sparkSession.read.parquet(path)
        if "error" in there.columns:
            there = there.where("error IS NULL")
        return there.select("request")
    except AnalysisException as error:
        if error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            return None
        raise
