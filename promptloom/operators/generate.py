"""The model call: one text per row of messages.

Two kinds of backend. An :class:`ExpressionBackend` answers with a Column
expression and stays in the JVM. A :class:`PythonBackend` is opened once per
Python worker and called for Arrow batches of rows. With a ``log`` every batch of
answers is written down before the next call, so a task that is tried again, or a
run that is started again, asks only what has no answer yet.
"""

from __future__ import annotations

import hashlib
import json
import random
import signal
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

@dataclass(frozen=True)
class Answer:
    """What a call may return instead of a bare text."""

    text: str | None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    finish_reason: str | None = None


# Called with a list of message lists and a list of settings, one per row.
Call = Callable[[list[list], list[dict]], list[str | Answer]]


@dataclass(frozen=True)
class ExpressionBackend:
    """``answer`` maps a Column of messages to a Column of text."""

    answer: Callable[[Column], Column]


@dataclass(frozen=True)
class PythonBackend:
    """``open`` runs in the Python worker and returns the function to call."""

    open: Callable[[], Call]
    batch: bool = False
    batch_rows: int = 32
    attempts: int = 30
    wait_min: float = 8.0
    wait_max: float = 500.0
    timeout: float | None = None
    rows_per_task: int | None = None  # tasks grow with the rows; None: one per core or partition
    log: str | None = None  # a folder that driver and executors reach
    fatal: tuple[type[BaseException], ...] = field(default=())


Backend = ExpressionBackend | PythonBackend

# marks an error column that is null by construction
NEVER = "never"

OUTPUT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "usage",
            T.StructType(
                [
                    T.StructField("prompt_tokens", T.LongType()),
                    T.StructField("completion_tokens", T.LongType()),
                ]
            ),
        ),
        T.StructField("finish_reason", T.StringType()),
    ]
)


def generate(
    df: DataFrame,
    backend: Backend,
    spread_by: Sequence[str],
    messages: str = "messages",
    params: str | None = None,
    partitions: int | None = None,
    render: Column | None = None,
    unfold: Callable[[DataFrame], DataFrame] | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Replace the messages by ``text, time, attempts, error, usage, finish_reason``.

    Rows are dealt over ``partitions`` by the hash of ``spread_by`` (which
    should identify a row), so that the points of one long outline do not all
    queue in one task. The number is explicit, because calls take longer than
    the size of their rows tells and adaptive execution would merge them into
    few tasks; with ``rows_per_task`` the rows are counted first, without their
    messages, and tasks grow with them. A call that fails for good leaves a null text
    and its error; it never fails the task. With ``render`` the messages are made from
    the other columns where the call is, so only what they are made of is dealt. ``unfold`` does the
    same for rows that make several calls each: it gives the rows of the calls, which ``keys`` identify,
    with their messages and the columns to keep. ``usage`` and ``finish_reason`` are null
    unless the call returns an :class:`Answer`.
    """
    if isinstance(backend, ExpressionBackend):
        df = df if unfold is None else unfold(df)
        df = df if render is None else df.withColumn(messages, render)
        return df.withColumns(
            {
                "text": backend.answer(F.col(messages)),
                "time": F.lit(None).cast("double"),
                "attempts": F.lit(1),
                "error": F.lit(None).cast("string").alias("error", metadata={NEVER: True}),
                "usage": F.lit(None).cast(OUTPUT["usage"].dataType),
                "finish_reason": F.lit(None).cast("string"),
            }
        ).drop(messages)
    keys = list(keys or spread_by)
    if partitions is None:
        partitions = call_tasks(df if unfold is None else unfold(df), backend, keys)
    dealt = df.repartition(partitions, *spread_by)
    if backend.log:
        # the batches of a task are those of its earlier attempts
        dealt = dealt.sortWithinPartitions(*spread_by)
    if render is not None:
        dealt = dealt.withColumn(messages, render)
    if unfold is not None:
        dealt = unfold(dealt)
    kept = [f for f in dealt.schema.fields if f.name != messages]
    schema = T.StructType([*kept, *OUTPUT.fields])
    return dealt.mapInArrow(_runner(backend, messages, params, keys), schema)


def never_fails(answered: DataFrame) -> bool:
    """Whether ``error`` comes from an :class:`ExpressionBackend` and is null everywhere."""
    return answered.schema["error"].metadata.get(NEVER, False)


def call_tasks(calls: DataFrame, backend: PythonBackend, keys: Sequence[str]) -> int:
    """Over how many tasks these calls are dealt."""
    if backend.rows_per_task:
        # the messages are not made for the count
        return max(1, -(-calls.select(*keys).count() // backend.rows_per_task))
    spark = calls.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def _runner(backend: PythonBackend, messages: str, params: str | None, keys: list[str]):
    usage = pa.struct([("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64())])
    types = [pa.string(), pa.float64(), pa.int32(), pa.string(), usage, pa.string()]
    names = OUTPUT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = backend.open()
        log = CallLog(backend.log) if backend.log else None
        step = backend.batch_rows if backend.batch else 1
        for batch in batches:
            asked = batch.column(messages).to_pylist()
            settings = batch.column(params).to_pylist() if params else [{}] * len(asked)
            answers = []
            for start in range(0, len(asked), backend.batch_rows):
                stop = min(start + backend.batch_rows, len(asked))
                if log:
                    rows = [batch.column(k).slice(start, stop - start).to_pylist() for k in keys]
                    name = log.name(rows, asked[start:stop], settings[start:stop])
                    known = log.read(name)
                    if known is not None:
                        answers += known
                        continue
                new = []
                for at in range(start, stop, step):
                    end = min(at + step, stop)
                    new += _attempt(backend, call, asked[at:end], settings[at:end])
                if log:
                    log.write(name, new)
                answers += new
            # the other columns go through untouched
            kept = [c for c in batch.schema.names if c != messages]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(v, t) for v, t in zip(zip(*answers), types)] if answers else []
            if answers:
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return run


def _attempt(backend: PythonBackend, call: Call, asked: list[list], settings: list[dict]):
    """One call with retries; every row of the batch gets the batch's time."""
    error = None
    for attempt in range(1, backend.attempts + 1):
        start = time.monotonic()
        try:
            with _time_limit(backend.timeout):
                texts = call(asked, settings)
            took = time.monotonic() - start
            if len(texts) != len(asked):
                raise ValueError(f"{len(texts)} answers to {len(asked)} requests")
            return [_row(text, took, attempt) for text in texts]
        except Exception as exc:
            error = f"{type(exc).__name__}: {exc}"
            if isinstance(exc, backend.fatal) or attempt == backend.attempts:
                break
            time.sleep(_wait(backend, attempt))
    return [(None, None, attempt, error, None, None)] * len(asked)


def _row(said: str | Answer, took: float, attempt: int) -> tuple:
    if not isinstance(said, Answer):
        return (said, took, attempt, None, None, None)
    counts = {"prompt_tokens": said.prompt_tokens, "completion_tokens": said.completion_tokens}
    told = None if said.prompt_tokens is None and said.completion_tokens is None else counts
    return (said.text, took, attempt, None, told, said.finish_reason)


class CallLog:
    """Answers of finished calls, a file per ``batch_rows`` rows named by what was asked.

    A file appears under its name only when it is whole, and holds no failed
    answer. Batches are the same when a task is tried again, because rows are dealt
    and sorted by their keys, which are part of the name.
    """

    def __init__(self, folder: str) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)

    def name(self, *parts: list) -> str:
        said = json.dumps(parts, default=str, ensure_ascii=True)
        return f"{self.folder}/{hashlib.sha256(said.encode()).hexdigest()}.json"

    def read(self, name: str) -> list[tuple] | None:
        if self.system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(name) as stream:
            return [tuple(row) for row in json.loads(stream.read())]

    def write(self, name: str, answers: list[tuple]) -> None:
        if any(row[3] is not None for row in answers):
            return
        made = f"{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(made) as stream:
            stream.write(json.dumps(answers, ensure_ascii=True).encode())
        self.system.move(made, name)


def _wait(backend: PythonBackend, attempt: int) -> float:
    """Random wait whose upper bound doubles with every attempt."""
    top = min(max(2.0 ** (attempt - 1), backend.wait_min), backend.wait_max)
    return random.uniform(backend.wait_min, top)


@contextmanager
def _time_limit(seconds: float | None):
    if not seconds:
        yield
        return

    def expire(signum, frame):
        raise TimeoutError(f"no answer within {seconds} s")

    previous = signal.signal(signal.SIGALRM, expire)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, previous)


def error_sentinel(text: Column, error: Column, sentinel: str) -> Column:
    """The sentinel where the call failed."""
    return F.when(error.isNotNull(), F.lit(sentinel)).otherwise(text)


# Settings of a call unless the run says otherwise.
SETTINGS = {
    "temperature": (0.7, "double"),
    "top_p": (1.0, "double"),
    "max_new_tokens": (512, "int"),
    "frequency_penalty": (0.0, "double"),
    "presence_penalty": (0.0, "double"),
    "system_message": (None, "string"),
}


def gen_params(model: Column, **settings: Column | float | int | str) -> Column:
    """Settings of a call as a struct, each one value or a column.

    So one job may mix settings. ``repetition_penalty`` is 1.2 for ``t5`` models
    and 1.0 for others, if it is not given.
    """
    unknown = set(settings) - set(SETTINGS) - {"repetition_penalty"}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")

    def value(name: str, default: object, kind: str) -> Column:
        given = settings.get(name, default)
        return (given if isinstance(given, Column) else F.lit(given)).cast(kind).alias(name)

    penalty = F.when(model.contains("t5"), 1.2).otherwise(1.0)
    return F.struct(
        *[value(name, default, kind) for name, (default, kind) in SETTINGS.items()],
        value("repetition_penalty", penalty, "double"),
    )
