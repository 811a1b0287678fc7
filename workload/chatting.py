"""Chat admission, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.operators.chat import (
    admit_message,
    chunk_delta,
    chunk_final,
    chunk_sample,
    session_gate,
    side_by_side,
)
from promptloom.operators.generate import PythonBackend
from promptloom.operators.points import explode_points
from promptloom.plans import schedulers
from promptloom.session import scratch_path
from promptloom.streaming.admit import admit_stream
from promptloom.streaming.reassemble import (
    reassemble_sessions,
    reassemble_state,
    reassemble_windows,
)
from promptloom.streaming.run import drain_batches, drain_to_parquet, result_of
from workload.evaluating import _NEWLINE_SQL, _summary
from workload.fixtures import (
    CHUNKS_SQL,
    MODEL,
    N_CHUNKS,
    OTHER_CHUNKS_SQL,
    PLAIN_CONTENT_SQL,
    PLAIN_PROMPTS,
    PLAIN_SQL,
    POINTS_SQL,
    PROMPTS,
    REQUESTS_SQL,
    SWITCHED_SQL,
    chunks,
    python_model,
    requests,
)
from workload.registry import query, table

TURN_LIMIT = 2
CHAR_LIMIT = 300


@query(
    "admit_message",
    f"""WITH m AS (SELECT c.conv_id, c.turn, text, coalesce(quality, 1) = 1 AS active,
        coalesce(toxic, 0) = 1 AS flagged FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id
        WHERE role = 'user'),
    d AS (SELECT *, CASE WHEN length(text) = 0 THEN 'empty' WHEN NOT active THEN 'inactive'
        WHEN flagged THEN 'moderation' WHEN turn // 2 >= {TURN_LIMIT} THEN 'turn_limit' ELSE 'accepted' END AS decision FROM m)
    SELECT conv_id, turn, decision, CASE WHEN decision = 'accepted' THEN left(text, {CHAR_LIMIT}) END AS text FROM d""",
)
def q_admit_message(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "conv_id")
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    rows = said.join(labels, "conv_id", "left")
    decision, text = admit_message(
        F.col("text"),
        F.coalesce(F.col("quality"), F.lit(1)) == 1,
        F.coalesce(F.col("toxic"), F.lit(0)) == 1,
        F.col("turn"),
        TURN_LIMIT,
        CHAR_LIMIT,
    )
    return rows.select("conv_id", "turn", decision.alias("decision"), text.alias("text"))


SESSION_SECONDS = 24 * 3600

_EVENTS_SQL = """e AS (SELECT event_id, user_id AS ip, ts, event_type = 'signup' AS is_load, props AS text,
    event_type = 'error' AS flagged, CAST(event_id % 9 AS INTEGER) AS n_messages FROM events)"""


def _events(events):
    return events.select(
        "event_id",
        F.col("user_id").alias("ip"),
        # the same instant whatever time zone the session has
        F.expr(
            "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"
        ).alias("ts"),
        (F.col("event_type") == "signup").alias("is_load"),
        F.col("props").alias("text"),
        (F.col("event_type") == "error").alias("flagged"),
        (F.col("event_id") % 9).cast("int").alias("n_messages"),
    )


@query(
    "session_gate",
    f"""WITH {_EVENTS_SQL}, g AS (SELECT *, max(CASE WHEN is_load THEN ts END) OVER (PARTITION BY ip
        ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_load FROM e)
    SELECT event_id, ip, epoch_us(last_load) AS last_load,
        coalesce(epoch_us(last_load) + {SESSION_SECONDS * 1_000_000}::BIGINT >= epoch_us(ts), false) AS active
    FROM g WHERE NOT is_load""",
)
def q_session_gate(spark, sf_dir):
    gated = session_gate(_events(table(spark, sf_dir, "events")), SESSION_SECONDS)
    return gated.select("event_id", "ip", F.unix_micros("last_load").alias("last_load"), "active")


@query(
    "admit_stream",
    f"""WITH {_EVENTS_SQL}, g AS (SELECT *, EXISTS (SELECT 1 FROM e l WHERE l.is_load AND l.ip = m.ip
            AND l.ts <= m.ts AND epoch_us(l.ts) + {SESSION_SECONDS * 1_000_000}::BIGINT >= epoch_us(m.ts)) AS active
        FROM e m WHERE NOT is_load),
    d AS (SELECT *, CASE WHEN length(text) = 0 THEN 'empty' WHEN NOT active THEN 'inactive'
        WHEN flagged THEN 'moderation' WHEN n_messages // 2 >= {TURN_LIMIT} THEN 'turn_limit' ELSE 'accepted' END AS decision FROM g)
    SELECT event_id, ip, decision, CASE WHEN decision = 'accepted' THEN left(text, {CHAR_LIMIT}) END AS text FROM d""",
)
def q_admit_stream(spark, sf_dir):
    """The events come in four parts, one after the other, each a restart of the stream
    that goes on with the loads of the parts before."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    part = F.floor(F.lit(4) * (at - first) / F.lit((last or 0) - (first or 0) + 1))
    folder, path = scratch_path(spark, "events"), scratch_path(spark, "admitted")
    for number in range(4):
        events.where(part == number).write.mode("append").parquet(folder)
        stream = _events(spark.readStream.schema(events.schema).parquet(folder).repartition("event_id"))
        admit_stream(stream, path, f"{path}-checkpoint", SESSION_SECONDS, 3600, TURN_LIMIT, CHAR_LIMIT)
    return spark.read.parquet(path).drop("batch")


def _stream(spark, sf_dir, name, key):
    """A given table, one file or a folder of files, as a stream of files, its rows dealt
    over all tasks."""
    schema = table(spark, sf_dir, name).schema
    # as a pattern, because the path of a stream that is no pattern has to be a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return stream.repartition(key)


# ---- snapshots --------------------------------------------------------------

_STREAMS_SQL = f"""{CHUNKS_SQL},
c AS (SELECT request_id, seq, string_split(regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), ' ') AS w FROM chunks),
n AS (SELECT *, len(w) - 1 AS now FROM c),
p AS (SELECT *, coalesce(max(now) OVER (PARTITION BY request_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM n)"""


@query(
    "chunk_delta",
    f"""WITH {_STREAMS_SQL}
    SELECT request_id, 'outline' AS stage, 0 AS point_index, seq::INTEGER AS seq,
        CASE WHEN now > pre THEN array_to_string(w[pre + 1:now], ' ') || ' ' ELSE '' END AS delta,
        CASE WHEN seq = {N_CHUNKS - 1} THEN array_to_string(w[greatest(pre, now) + 1:len(w)], ' ') END AS flush
    FROM p""",
)
def q_chunk_delta(spark, sf_dir):
    streams = chunks(spark, sf_dir).withColumns(
        {"stage": F.lit("outline"), "point_index": F.lit(0)}
    )
    return chunk_delta(streams)


@query("chunk_final", "SELECT doc_id AS request_id, 11 AS seq, text FROM documents")
def q_chunk_final(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return chunk_final(rows.select("request_id", "seq", "text"))


_CHUNK_ERRORS_SQL = "CASE WHEN request_id % 5 = 0 AND seq = 7 THEN 50001 ELSE 0 END"


@query(
    "chunk_sample",
    f"""WITH {CHUNKS_SQL}, e AS (SELECT request_id, seq::INTEGER AS seq, text, {_CHUNK_ERRORS_SQL} AS error_code,
        regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS stripped FROM chunks)
    SELECT request_id, seq, 'partial' AS kind, md5(stripped || '▌') AS shown FROM e
        WHERE seq % 5 = 0 AND error_code = 0 AND NOT (request_id % 5 = 0 AND seq > 7)
    UNION ALL SELECT request_id, seq, 'error', md5(text || chr(10) || chr(10) || '(error_code: 50001)') FROM e WHERE error_code <> 0
    UNION ALL SELECT request_id, seq, 'final', md5(stripped) FROM e WHERE seq = {N_CHUNKS - 1} AND request_id % 5 <> 0""",
)
def q_chunk_sample(spark, sf_dir):
    failed = (F.col("request_id") % 5 == 0) & (F.col("seq") == 7)
    rows = chunks(spark, sf_dir).withColumn("error_code", F.when(failed, 50001).otherwise(0))
    return chunk_sample(rows).withColumn("shown", F.md5("shown"))


@query(
    "side_by_side",
    f"""WITH {CHUNKS_SQL}, {OTHER_CHUNKS_SQL},
    s AS (SELECT request_id, seq FROM chunks UNION SELECT request_id, seq FROM others)
    SELECT s.request_id, s.seq::INTEGER AS step, md5(a.text) AS left_text, md5(b.text) AS right_text FROM s
        JOIN sized z ON z.request_id = s.request_id
        JOIN chunks a ON a.request_id = s.request_id AND a.seq = least(s.seq, {N_CHUNKS - 1})
        JOIN others b ON b.request_id = s.request_id AND b.seq = least(s.seq, z.c - 1)""",
)
def q_side_by_side(spark, sf_dir):
    both = side_by_side(chunks(spark, sf_dir), chunks(spark, sf_dir, uneven=True))
    return both.withColumns({"left_text": F.md5("left_text"), "right_text": F.md5("right_text")})


# ---- streams ----------------------------------------------------------------


@query(
    "stream_generate",
    f"WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL} {_NEWLINE_SQL}",
)
def q_stream_generate(spark, sf_dir):
    asked = _stream(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("request")
    )
    answered = schedulers.batch_outline(asked, MODEL, PLAIN_PROMPTS)
    return _summary(result_of(spark, answered, "answers"))


@query(
    "stream_generate_python",
    f"WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {PLAIN_CONTENT_SQL} {_NEWLINE_SQL}",
)
def q_stream_generate_python(spark, sf_dir):
    asked = _stream(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("request")
    )
    path = scratch_path(spark, "answers")
    backend = PythonBackend(python_model, batch=True, batch_rows=64)
    drain_batches(
        asked,
        lambda batch: schedulers.batch_outline(batch, backend, PLAIN_PROMPTS),
        path,
        f"{path}-checkpoint",
    )
    return _summary(spark.read.parquet(path))


def _point_files(spark, sf_dir, prompts):
    """Points written as files, to be read back as a stream: every point of a
    request some seconds after the one before. A request without points is a row
    too, with a null ``pos``."""
    planned = schedulers.outlined(requests(spark, sf_dir), MODEL, prompts)
    rows = explode_points(planned.withColumn("n_points", F.size("points")))
    seconds = F.lit(1704067200) + F.col("request_id") + F.coalesce("pos", F.lit(0))
    points = rows.select(
        "request_id",
        "pos",
        "n_points",
        F.concat("point", F.lit(". "), "point_outline").alias("content"),
        F.timestamp_seconds(seconds).alias("ts"),
    )
    path = scratch_path(spark, "points")
    points.write.parquet(path)
    return path, points.schema


# every point of every request, and a row with a null pos for a request without points
_ROWS_SQL = """
rows AS (SELECT o.request_id, pos, point || '. ' || point_outline AS content,
    1704067200 + o.request_id + coalesce(pos, 0) AS second,
    count(pos) OVER (PARTITION BY o.request_id)::INTEGER AS n
    FROM outlines o LEFT JOIN points p ON p.request_id = o.request_id)
"""

_RESPONSE_SQL = "md5(coalesce(string_agg(content, chr(10) || chr(10) ORDER BY pos), '')) AS response"


@query(
    "stream_reassemble",
    f"""WITH {REQUESTS_SQL}, {SWITCHED_SQL}, {POINTS_SQL}, {_ROWS_SQL}
    SELECT request_id, max(n) AS n_points, count(pos)::INTEGER AS n_seen, true AS complete, {_RESPONSE_SQL}
    FROM rows GROUP BY request_id""",
)
def q_stream_reassemble(spark, sf_dir):
    path, schema = _point_files(spark, sf_dir, PROMPTS)
    stream = spark.readStream.schema(schema).parquet(path)
    whole = reassemble_state(stream, "10 minutes", "1 day")
    return result_of(spark, whole, "reassembled").withColumn("response", F.md5("response"))


@query(
    "stream_reassemble_windows",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {_ROWS_SQL},
    slots AS (SELECT request_id, second // 60 AS slot, max(n) AS n_points, count(pos)::INTEGER AS n_seen,
        {_RESPONSE_SQL} FROM rows GROUP BY 1, 2)
    SELECT request_id, n_points, n_seen, n_points = n_seen AS complete, response FROM slots
    WHERE slot < (SELECT max(second) // 60 FROM rows)""",
)
def q_stream_reassemble_windows(spark, sf_dir):
    """Windows the watermark has passed; the newest one stays open."""
    path, schema = _point_files(spark, sf_dir, PLAIN_PROMPTS)
    stream = spark.readStream.schema(schema).parquet(path)
    closed = reassemble_windows(stream, "1 minute", "0 seconds")
    return result_of(spark, closed, "windows").withColumn("response", F.md5("response"))


@query(
    "stream_late_points",
    f"""WITH {REQUESTS_SQL}, {PLAIN_SQL}, {POINTS_SQL}, {_ROWS_SQL}
    SELECT request_id, max(n) AS n_points, count(pos)::INTEGER AS n_seen, count(pos) = max(n) AS complete,
        {_RESPONSE_SQL}
    FROM rows WHERE NOT (coalesce(pos, 0) = 1 AND request_id % 4 = 0) GROUP BY request_id""",
)
def q_stream_late_points(spark, sf_dir):
    """The second point of every fourth request comes days late and is dropped;
    those requests are answered incomplete when their time is over."""
    path, schema = _point_files(spark, sf_dir, PLAIN_PROMPTS)
    points = spark.read.schema(schema).parquet(path)
    late = (F.coalesce("pos", F.lit(0)) == 1) & (F.col("request_id") % 4 == 0)
    # a row without request moves the watermark on, as later traffic would
    clock = points.agg(F.max("ts").alias("latest")).select(
        F.lit(-1).cast("long").alias("request_id"),
        F.lit(0).alias("pos"),
        F.lit(1).alias("n_points"),
        F.lit("").alias("content"),
        (F.col("latest") + F.expr("INTERVAL 3 DAYS")).alias("ts"),
    )
    folder, result = scratch_path(spark, "late"), scratch_path(spark, "late-answers")
    # rows are judged late by the watermark of the batch before theirs
    for part in (points.where(~late), clock, points.where(late)):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        whole = reassemble_sessions(stream, "1 hour", "1 minute")
        drain_to_parquet(whole, result, f"{result}-checkpoint")
    answered = spark.read.schema(whole.schema).parquet(result).where(F.col("request_id") >= 0)
    return answered.withColumn("response", F.md5("response"))
