"""Joining answered points into responses on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

RESPONSE = "request_id LONG, n_points INT, n_seen INT, response STRING, complete BOOLEAN"


def reassemble_windows(points: DataFrame, window: str, delay: str, separator: str = "\n\n") -> DataFrame:
    """Responses of points that fall into one event-time window, in append mode.

    ``points`` has ``request_id, pos, n_points, content, ts``. A response is
    emitted when the watermark passes the window; ``complete`` tells whether all
    points came. Rows later than ``delay`` are dropped by the watermark. A row with a
    null ``pos`` stands for a request without points, whose response is empty.
    """
    grouped = (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "request_id")
        .agg(F.max("n_points").alias("n_points"), _entries())
    )
    return _responses(grouped, separator)


def reassemble_sessions(
    points: DataFrame, patience: str, delay: str, separator: str = "\n\n"
) -> DataFrame:
    """One response per request, emitted ``patience`` after its latest point.

    The same as :func:`reassemble_state` without the early answer for complete
    requests, and all of it a built-in aggregation: the form for throughput.
    """
    grouped = (
        points.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", patience), "request_id")
        .agg(F.max("n_points").alias("n_points"), _entries())
    )
    return _responses(grouped, separator)


def _entries() -> Column:
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "content"))
    return F.array_sort(F.collect_set(entry)).alias("entries")


def _responses(grouped: DataFrame, separator: str) -> DataFrame:
    return grouped.select(
        "request_id",
        "n_points",
        F.size("entries").alias("n_seen"),
        F.array_join("entries.content", separator).alias("response"),
        (F.size("entries") == F.col("n_points")).alias("complete"),
    )


class Reassembler(StatefulProcessor):
    """The points of one request in the state store: one entry per point, and a timer.

    The timer stands at the latest point's time plus the patience. When it fires, an
    incomplete request is answered as it is, and whatever is left of it is forgotten.
    Every access to the state is a message to the store, so points that complete a request
    on arrival are not stored, and stored ones are read at once.
    """

    def __init__(self, millis: int, separator: str) -> None:
        self.millis, self.separator = millis, separator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "n_points INT, deadline LONG, answered BOOLEAN")
        self.points = handle.getMapState("points", "pos INT", "content STRING")

    def handleInputRows(
        self, key: tuple, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        known = self.about.get()
        n, deadline, answered = known or (0, 0, False)
        latest, came = deadline, {}
        for row in rows:
            n = row["n_points"]
            latest = max(latest, row["millis"] + self.millis)
            # a row without point stands for a request without points
            if row["pos"] is not None:
                came.setdefault(row["pos"], row["content"])
        if latest != deadline:
            if known:
                self.handle.deleteTimer(deadline)
            self.handle.registerTimer(latest)
        if not answered:
            stored = self._seen() if known else {}
            seen = came | stored
            answered = len(seen) >= n
            if answered:
                # the request is remembered without its points until the timer fires
                if stored:
                    self.points.clear()
                yield _response(key[0], n, seen, self.separator)
            else:
                for pos in came.keys() - stored.keys():
                    self.points.updateValue((pos,), (came[pos],))
        if (n, latest, answered) != known:
            self.about.update((n, latest, answered))

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        n, _, answered = self.about.get()
        if not answered:
            yield _response(key[0], n, self._seen(), self.separator)
            self.points.clear()
        self.about.clear()

    def _seen(self) -> dict[int, str]:
        return {pos[0]: content[0] for pos, content in self.points.iterator()}

    def close(self) -> None:
        pass


def reassemble_state(points: DataFrame, patience: str, delay: str, separator: str = "\n\n") -> DataFrame:
    """Responses as soon as all ``n_points`` points are in.

    A request that stays incomplete is emitted with ``complete`` false once the
    watermark is ``patience`` past its latest point. The state of a request is
    its own points, at most ``n_points``. Until that time a complete request is
    remembered without its points, so a point that is delivered again adds no response.
    A row with a null ``pos`` and 0 as ``n_points`` is answered at once, with nothing.
    """
    millis = int(pd.Timedelta(patience).total_seconds() * 1000)
    timed = points.withWatermark("ts", delay).withColumn("millis", F.unix_millis("ts"))
    return timed.groupBy("request_id").transformWithState(
        Reassembler(millis, separator), RESPONSE, "append", "eventTime"
    )


def _response(request_id: int, n: int, seen: dict, separator: str) -> Row:
    return Row(
        request_id=request_id,
        n_points=n,
        n_seen=len(seen),
        response=separator.join(seen[p] for p in sorted(seen)),
        complete=len(seen) >= n,
    )
