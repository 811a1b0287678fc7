"""From questions to answers.

Every scheduler takes ``request_id, messages`` and returns one row per request.
With an :class:`ExpressionBackend` a whole run is one projection. With a
:class:`PythonBackend` the points of all outlines are dealt over the cluster,
and every stage of model output is written before it is read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.messages import (
    as_messages,
    checked_messages,
    last_message,
    with_last,
    with_partial,
)
from promptloom.functions.outline import dedupe_points, full_outline, parse_points
from promptloom.functions.template import (
    render_outline_prompt,
    render_point_prompt,
    render_template,
)
from promptloom.functions.text import strip
from promptloom.operators.generate import (
    Backend,
    ExpressionBackend,
    PythonBackend,
    call_tasks,
    generate,
)
from promptloom.operators.pairing import split_route
from promptloom.operators.points import assemble, explode_points
from promptloom.session import materialise
from promptloom.sources.prompts import OutlinePrompts

Layout = Callable[[Column], Column]

POINTS = "array<struct<point:string,point_outline:string>>"

# points of an outline that are asked for in one task, unless there are few requests
PIECE_POINTS = 256
# an outline goes to no more tasks than this, so its text travels a bounded number of times
MOST_PIECES = 8


def normalise(requests: DataFrame) -> DataFrame:
    """``request_id, messages`` from a ``request`` text or a ``messages`` array."""
    if "messages" in requests.columns:
        messages = checked_messages(F.col("messages"))
    else:
        messages = as_messages(F.col("request"))
    return requests.withColumn("messages", messages).drop("request")


def _ask(
    df: DataFrame, backend: Backend, asked: Column, layout: Layout | None, keys: list[str]
) -> DataFrame:
    """Lay out and send ``asked``, made after the rows are dealt; written once if a Python
    worker answered."""
    rendered = layout(asked) if layout else asked
    answered = generate(df, backend, keys, messages="asked", render=rendered)
    answered = answered.drop("attempts", "usage", "finish_reason")
    return answered if isinstance(backend, ExpressionBackend) else materialise(answered)


def naive(
    requests: DataFrame,
    backend: Backend,
    prompt: str = "{request}",
    layout: Layout | None = None,
) -> DataFrame:
    """Answer every request as it is."""
    messages = F.col("messages")
    asked = with_last(messages, render_template(prompt, {"request": last_message(messages)}))
    return _ask(normalise(requests), backend, asked, layout, ["request_id"]).select(
        "request_id",
        messages.alias("request"),
        F.col("text").alias("response"),
        F.lit("summarize").alias("stage"),
        "text",
        "time",
        "error",
    )


def outline_messages(messages: Column, prompts: OutlinePrompts) -> Column:
    question, partial = render_outline_prompt(prompts.outline_prompt, last_message(messages))
    return with_partial(messages, question, partial)


def point_parts(
    messages: Column, outline: Column, point: Column, point_outline: Column, prompts: OutlinePrompts
) -> tuple[Column, Column]:
    """Messages that ask for one point, and the partial answer among them."""
    question, partial = render_point_prompt(
        prompts.point_prompt, last_message(messages), outline, point, point_outline
    )
    return with_partial(messages, question, partial), partial


def outlined(
    requests: DataFrame, backend: Backend, prompts: OutlinePrompts, layout: Layout | None = None
) -> DataFrame:
    """``request_id, messages, outline, outline_time, outline_error, points``."""
    messages = F.col("messages")
    _, partial = render_outline_prompt(prompts.outline_prompt, last_message(messages))
    answered = _ask(
        normalise(requests), backend, outline_messages(messages, prompts), layout, ["request_id"]
    )
    found = dedupe_points(parse_points(F.col("outline")))
    return answered.select(
        "request_id",
        "messages",
        full_outline(partial, F.col("text")).alias("outline"),
        F.col("time").alias("outline_time"),
        F.col("error").alias("outline_error"),
    ).withColumn("points", F.coalesce(found, F.array().cast(POINTS)))


def _expanded(
    requests: DataFrame,
    backend: Backend,
    prompts: OutlinePrompts,
    layout: Layout | None,
    separator: str,
    stripped: bool,
) -> DataFrame:
    """Outline, then one entry per point in ``contents`` and ``times``."""
    plan = outlined(requests, backend, prompts, layout)
    if isinstance(backend, ExpressionBackend):
        # all points of a request are answered in its own row: no shuffle
        def content(p: Column) -> Column:
            asked, partial = point_parts(
                F.col("messages"), F.col("outline"), p["point"], p["point_outline"], prompts
            )
            text = backend.answer(layout(asked) if layout else asked)
            text = strip(text) if stripped else text
            return F.when(
                F.coalesce(partial, F.lit("")) != "", F.concat(partial, F.lit(" "), text)
            ).otherwise(text)

        done = plan.withColumns(
            {
                "contents": F.transform("points", content),
                "times": F.transform("points", lambda p: F.lit(None).cast("double")),
                "error": F.col("outline_error"),
            }
        )
        return done.withColumn("response", F.array_join("contents", separator))

    answered = _ask_points(plan, backend, prompts, layout)
    contents = assemble(answered, separator, stripped, extra=("time", "error"))
    failed = F.get(F.filter("error", lambda e: e.isNotNull()), F.lit(0))
    return plan.join(contents, "request_id", "left").withColumns(
        {
            "contents": F.coalesce("contents", F.array().cast("array<string>")),
            "response": F.coalesce("response", F.lit("")),
            "times": F.coalesce("time", F.array().cast("array<double>")),
            "error": F.coalesce("outline_error", failed),
        }
    )


def _ask_points(
    plan: DataFrame, backend: PythonBackend, prompts: OutlinePrompts, layout: Layout | None
) -> DataFrame:
    """``request_id, pos, partial, text, time, error`` of every point of the outlines.

    Question and outline are dealt once per piece of an outline and its points unfold where
    the calls are, so what travels and what is written grow with the texts and not
    with texts times points. A piece is all points of an outline but of a very long one, or
    where there are fewer requests than keep the tasks busy.
    """

    def unfold(pieces: DataFrame) -> DataFrame:
        rows = pieces.select(
            "request_id", "messages", "outline", "first", F.posexplode("points").alias("at", "p")
        )
        asked, partial = point_parts(
            F.col("messages"), F.col("outline"), F.col("p.point"), F.col("p.point_outline"), prompts
        )
        return rows.select(
            "request_id",
            (F.col("first") + F.col("at")).alias("pos"),
            partial.alias("partial"),
            (layout(asked) if layout else asked).alias("asked"),
        )

    whole = plan.where(F.size("points") > 0).select("request_id", "messages", "outline", "points")
    tasks = call_tasks(unfold(whole.withColumn("first", F.lit(0))), backend, ["request_id", "pos"])
    n = F.size("points")
    least = -(-4 * tasks // max(plan.count(), 1))
    pieces = F.least(n, F.greatest(F.lit(least), F.least(F.ceil(n / PIECE_POINTS), F.lit(MOST_PIECES))))
    step = F.ceil(n / pieces).cast("int")
    cut = whole.withColumn("first", F.explode(F.sequence(F.lit(0), n - 1, step))).withColumn(
        "points", F.slice("points", F.col("first") + 1, step)
    )
    answered = generate(
        cut,
        backend,
        ["request_id", "first"],
        messages="asked",
        partitions=tasks,
        unfold=unfold,
        keys=["request_id", "pos"],
    )
    return materialise(answered.drop("attempts", "usage", "finish_reason"))


def outline(
    requests: DataFrame,
    backend: Backend,
    prompts: OutlinePrompts,
    layout: Layout | None = None,
) -> DataFrame:
    """Outline, one answer per point, joined by blank lines."""
    return _expanded(requests, backend, prompts, layout, "\n\n", False).select(
        "request_id",
        F.col("messages").alias("request"),
        "response",
        F.lit("summarize").alias("stage"),
        "outline",
        "outline_time",
        F.col("points.point").alias("points"),
        F.col("points.point_outline").alias("point_outlines"),
        "contents",
        F.col("times").alias("contents_time"),
        "error",
    )


def batch_outline(
    requests: DataFrame,
    backend: Backend,
    prompts: OutlinePrompts,
    layout: Layout | None = None,
) -> DataFrame:
    """Outline, points answered in batches, stripped and joined by newlines.

    ``point_time`` is the longest time of a batch that held one of the points;
    without points the response is empty and the time null.
    """
    return _expanded(requests, backend, prompts, layout, "\n", True).select(
        "request_id",
        F.col("messages").alias("request"),
        "response",
        F.lit("summarize").alias("stage"),
        F.col("response").alias("text"),
        "outline",
        "outline_time",
        F.col("points.point").alias("points"),
        F.col("points.point_outline").alias("point_outlines"),
        "contents",
        F.array_max("times").alias("point_time"),
        "error",
    )


def router(
    requests: DataFrame,
    backend: Backend,
    prompts: OutlinePrompts,
    prompt: str = "{request}",
    layout: Layout | None = None,
    label: str = "label",
) -> DataFrame:
    """Label 0 is answered plainly, everything else by outline, in one table."""
    plain, pointed = split_route(requests, label)
    return naive(plain, backend, prompt, layout).unionByName(
        batch_outline(pointed, backend, prompts, layout), allowMissingColumns=True
    )


SCHEDULERS: dict[str, Callable[..., DataFrame]] = {
    "naive": naive,
    "outline": outline,
    "batch_outline": batch_outline,
    "router_batch_outline": router,
}


def get_scheduler(name: str) -> Callable[..., DataFrame]:
    if name not in SCHEDULERS:
        raise ValueError(f"unknown scheduler name {name!r}")
    return SCHEDULERS[name]
