"""Streams: the same results as batch, late and missing points, restarts."""

import datetime

import pytest
from pyspark.sql import Row

from promptloom.operators.generate import PythonBackend
from promptloom.plans import schedulers
from promptloom.sources.chat_log import SCHEMA, read_chat_log, stream_chat_log
from promptloom.streaming.admit import admit_stream
from promptloom.streaming.reassemble import (
    Reassembler,
    reassemble_sessions,
    reassemble_state,
    reassemble_windows,
)
from promptloom.streaming.run import drain_batches, drain_to_parquet, result_of
from workload import chatting
from workload.fixtures import PLAIN_PROMPTS, requests

START = datetime.datetime(2024, 1, 1)
POINTS = "request_id long, pos int, n_points int, content string, ts timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, tmp_path, reassemble, *parts):
    """Run the stream to the end after each part; the responses after each."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = []
    for part in parts:
        feed(spark, source, part)
        whole = reassemble(spark.readStream.schema(POINTS).parquet(source))
        drain_to_parquet(whole, out, checkpoint)
        rows = spark.read.schema(whole.schema).parquet(out).collect()
        seen.append({r["request_id"]: (r["response"], r["n_seen"], r["complete"]) for r in rows})
    return seen


ONE = [(1, 0, 2, "a", at(0)), (2, 0, 2, "x", at(1))]
TWO = [(1, 1, 2, "b", at(5)), (3, 0, 1, "solo", at(6))]
CLOCK = [(9, 0, 9, "tick", at(86400))]
LATE = [(2, 1, 2, "y", at(10))]


def test_state_answers_when_complete(spark, tmp_path):
    seen = drain(
        spark,
        tmp_path,
        lambda s: reassemble_state(s, "1 hour", "1 minute"),
        ONE,
        TWO,
        CLOCK,
        CLOCK,
        LATE,
    )
    assert seen[0] == {}
    assert seen[1] == {1: ("a\n\nb", 2, True), 3: ("solo", 1, True)}
    # request 2 gave up waiting; its late point is dropped
    assert seen[-1] == {**seen[1], 2: ("x", 1, False)}


def test_repeated_points_count_once(spark, tmp_path):
    seen = drain(
        spark, tmp_path, lambda s: reassemble_state(s, "1 hour", "1 minute"), ONE, ONE, TWO
    )
    assert seen[1] == {}
    assert seen[2][1] == ("a\n\nb", 2, True)


def test_redelivered_point_adds_no_response(spark, tmp_path):
    seen = drain(
        spark,
        tmp_path,
        lambda s: reassemble_state(s, "1 hour", "1 minute"),
        ONE,
        TWO,
        TWO[:1],
        CLOCK,
        CLOCK,
    )
    assert seen[2] == seen[1]
    assert seen[-1][1] == ("a\n\nb", 2, True)
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("request_id").count().collect()
    assert {r["request_id"]: r["count"] for r in rows} == {1: 1, 2: 1, 3: 1}


def test_sessions_answer_after_patience(spark, tmp_path):
    seen = drain(
        spark,
        tmp_path,
        lambda s: reassemble_sessions(s, "1 hour", "1 minute"),
        ONE,
        TWO,
        CLOCK,
        CLOCK,
        LATE,
    )
    assert seen[1] == {}
    assert seen[-1] == {1: ("a\n\nb", 2, True), 2: ("x", 1, False), 3: ("solo", 1, True)}


def test_windows(spark, tmp_path):
    seen = drain(spark, tmp_path, lambda s: reassemble_windows(s, "1 minute", "0 seconds"), ONE + TWO, CLOCK, CLOCK)
    assert seen[-1] == {1: ("a\n\nb", 2, True), 2: ("x", 1, False), 3: ("solo", 1, True)}


EMPTY = [(4, None, 0, None, at(2)), (4, None, 0, None, at(2))]


@pytest.mark.parametrize(
    "reassemble",
    [
        lambda s: reassemble_state(s, "1 hour", "1 minute"),
        lambda s: reassemble_sessions(s, "1 hour", "1 minute"),
        lambda s: reassemble_windows(s, "1 minute", "0 seconds"),
    ],
)
def test_requests_without_points_are_answered(spark, tmp_path, reassemble):
    seen = drain(spark, tmp_path, reassemble, ONE + EMPTY + TWO, CLOCK, CLOCK)
    want = {1: ("a\n\nb", 2, True), 3: ("solo", 1, True), 4: ("", 0, True)}
    assert seen[-1] == {**want, 2: ("x", 1, False)}
    rows = spark.read.parquet(str(tmp_path / "out")).where("request_id = 4").collect()
    assert [r["n_points"] for r in rows] == [0]


def test_every_request_of_the_given_table_is_answered(spark, sf_dir):
    path, schema = chatting._point_files(spark, sf_dir, PLAIN_PROMPTS)
    stream = spark.readStream.schema(schema).parquet(path)
    told = result_of(spark, reassemble_state(stream, "10 minutes", "1 day"), "all").collect()
    asked = {r["request_id"] for r in requests(spark, sf_dir).collect()}
    assert sorted(r["request_id"] for r in told) == sorted(asked)
    assert all(r["complete"] for r in told) and any(r["n_points"] == 0 for r in told)


def test_batches_run_any_plan_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    calls = spark.sparkContext.accumulator(0)

    def open_call():
        def call(messages, settings):
            calls.add(len(messages))
            return [m[-1][::-1] for m in messages]

        return call

    for batch in range(3):
        rows = [(batch * 10 + i, f"q{batch}{i}") for i in range(4)]
        asked = spark.createDataFrame(rows, "request_id long, request string")
        asked.write.mode("append").parquet(source)
        stream = spark.readStream.schema(asked.schema).parquet(source)
        drain_batches(
            stream, lambda df: schedulers.naive(df, PythonBackend(open_call)), out, checkpoint
        )
    answered = spark.read.parquet(out)
    assert answered.count() == 12 and calls.value == 12
    assert answered.where("request_id = 21").first()["response"] == "12q"


EVENTS = """event_id long, ip long, ts timestamp, is_load boolean, text string,
    flagged boolean, n_messages int"""


def test_admission_over_several_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batches = [
        [(1, 1, at(0), True, None, False, 0), (2, 1, at(50), False, "hello", False, 0)],
        # the load of the batch before still counts at 99 s, not at 101 s
        [(3, 1, at(99), False, "there", False, 2), (4, 1, at(101), False, "late", False, 0)],
        [(5, 1, at(100), False, "", False, 0), (6, 2, at(300), True, None, False, 0)],
        [
            (7, 2, at(301), False, "bad", True, 0),
            (8, 2, at(302), False, "more", False, 4),
            (9, 2, at(303), False, "a long one", False, 3),
            (10, 3, at(303), False, "who", False, 0),
        ],
    ]
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).write.mode("append").parquet(source)
        admit_stream(
            spark.readStream.schema(EVENTS).parquet(source), out, checkpoint, 100, 60, 2, 6
        )
    got = {r["event_id"]: (r["decision"], r["text"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        2: ("accepted", "hello"),
        3: ("accepted", "there"),
        4: ("inactive", None),
        5: ("empty", None),
        7: ("moderation", None),
        8: ("turn_limit", None),
        9: ("accepted", "a long"),
        10: ("inactive", None),
    }


def test_chat_log_of_a_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    row = (5.0, "chat", "m", (0.7, 1.0, 512), 86399.0, 86400.5, ("c", "m", [["user", "hi"]]), "ip")
    spark.createDataFrame([row], SCHEMA).write.parquet(source)
    stream_chat_log(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint).awaitTermination()
    got = read_chat_log(spark, out).first()
    assert str(got["date"]) == "1970-01-02" and got["state"]["messages"] == [["user", "hi"]]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_in_a_folder_is_streamed_as_one_in_a_file(spark, tmp_path, files):
    rows = [(i, f"one {i}\ntwo") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    if files == 1:
        part = next((tmp_path / "documents.parquet").glob("part-*"))
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
        tmp_path = tmp_path / "one"
    for query in (chatting.q_stream_generate, chatting.q_stream_generate_python):
        told = query(spark, str(tmp_path)).collect()
        assert sorted(r["request_id"] for r in told) == list(range(30))


class State:
    """A state store of one key that counts what it is asked."""

    def __init__(self):
        self.value, self.entries, self.timers, self.asked = None, {}, [], 0

    def getValueState(self, name, schema):
        return self._part(get=lambda: self.value, exists=lambda: self.value is not None, update=self._set)

    def getMapState(self, name, key, value):
        return self._part(
            containsKey=lambda k: k in self.entries,
            updateValue=self.entries.__setitem__,
            iterator=lambda: iter(self.entries.items()),
            clear=self.entries.clear,
        )

    def _set(self, value):
        self.value = value

    def _part(self, **calls):
        def counted(call):
            def ask(*args):
                self.asked += 1
                return call(*args)

            return staticmethod(ask)

        return type("Part", (), {k: counted(v) for k, v in calls.items()})()

    def registerTimer(self, at):
        self.asked += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


def test_a_request_that_is_complete_on_arrival_asks_the_state_a_few_times():
    state, tool = State(), Reassembler(1000, " ")
    tool.init(state)
    rows = [Row(pos=i, n_points=50, content=f"c{i}", millis=i) for i in range(50)]
    told = list(tool.handleInputRows((7,), iter(rows), None))
    assert [(r["request_id"], r["n_seen"], r["complete"]) for r in told] == [(7, 50, True)]
    assert told[0]["response"] == " ".join(f"c{i}" for i in range(50))
    assert state.asked <= 3 and state.timers == [1049] and not state.entries
    # in two parts: the first is kept, the second completes it
    state = State()
    tool.init(state)
    assert not list(tool.handleInputRows((8,), iter(rows[:20]), None))
    assert len(state.entries) == 20
    told = list(tool.handleInputRows((8,), iter(rows[10:]), None))
    assert told[0]["n_seen"] == 50 and not state.entries and state.timers == [1049]
    assert not list(tool.handleInputRows((8,), iter(rows[:1]), None))
