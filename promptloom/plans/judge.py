"""Comparing answer tables with a model as the judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.messages import as_messages
from promptloom.functions.scores import (
    FAILED,
    FAILED_REVIEW,
    parse_order,
    parse_score_pair,
)
from promptloom.functions.template import (
    list_judge_instruction,
    list_judge_prompt,
    pair_judge_prompt,
)
from promptloom.operators.generate import Backend, ExpressionBackend, error_sentinel, generate
from promptloom.operators.pairing import (
    align_n_answers,
    all_orders,
    criteria_cross,
    pair_answers,
    permute_answers,
    swap_directions,
    unpermute_order,
    unswap_scores,
)
from promptloom.operators.resume import skip_done
from promptloom.session import materialise


def _reviewed(df: DataFrame, backend: Backend, spread_by: list[str]) -> DataFrame:
    """Add ``review`` and ``error``; a failed call reads as its sentinel."""
    asked = df.withColumn("asked", as_messages(F.col("evaluation_request")))
    answered = generate(asked, backend, spread_by, messages="asked")
    answered = answered.drop("attempts", "time", "usage", "finish_reason")
    if not isinstance(backend, ExpressionBackend):
        answered = materialise(answered)
    return answered.withColumn(
        "review", error_sentinel(F.col("text"), F.col("error"), FAILED_REVIEW)
    ).drop("text")


def _unfinished(tables: Sequence[DataFrame], done: DataFrame | None) -> list[DataFrame]:
    """The rows whose request text is not in ``done``, found by the first table alone, so
    no answer meets another only to be left out."""
    if done is None:
        return list(tables)
    left = skip_done(tables[0].select("request_id", "request"), done)
    left = materialise(left.select("request_id").distinct(), "left")
    return [table.join(left, "request_id", "left_semi") for table in tables]


def pivot_pair_scores(long: DataFrame, key: str = "request_id") -> DataFrame:
    """Two rows per request to one: ``1_…`` and ``2_…`` columns by direction."""
    parts = ("evaluation_request", "evaluation", "score1", "score2")
    return long.groupBy(key).agg(
        F.max("request").alias("request"),
        *[
            F.max(F.when(F.col("direction") == d, F.col(c))).alias(f"{d}_{c}")
            for d in (1, 2)
            for c in parts
        ],
    )


def judge_pair(
    first: DataFrame,
    second: DataFrame,
    backend: Backend,
    template: str,
    prompt: str,
    wide: bool = True,
    done: DataFrame | None = None,
) -> DataFrame:
    """Judge two answer tables in both directions with one template.

    Requests whose text is in ``done`` are left out. The template is compiled
    into the plan; for templates by category use :func:`judge_pair_by_category`.
    """
    first, second = _unfinished([first, second], done)
    shown = swap_directions(pair_answers(first, second, ["request_id"]))
    asked = shown.withColumn(
        "evaluation_request",
        pair_judge_prompt(
            template, F.col("request"), F.col("shown_1"), F.col("shown_2"), F.lit(prompt)
        ),
    ).drop("shown_1", "shown_2")
    return _scored(asked, backend, wide)


def judge_pair_by_category(
    paired: DataFrame,
    backend: Backend,
    templates: Sequence[str],
    wide: bool = True,
    done: DataFrame | None = None,
) -> DataFrame:
    """Judge pairs that already carry ``prompt`` and ``prompt_template``.

    Requests whose text is in ``done`` are left out.

    ``templates`` are the different template texts, known to the driver from
    the template table; each is compiled once.
    """
    shown = swap_directions(skip_done(paired, done) if done is not None else paired)
    rendered = None
    for template in templates:
        text = pair_judge_prompt(
            template, F.col("request"), F.col("shown_1"), F.col("shown_2"), F.col("prompt")
        )
        here = F.col("prompt_template") == template
        rendered = F.when(here, text) if rendered is None else rendered.when(here, text)
    unknown = F.raise_error(F.lit("a pair's template is not among the given ones"))
    rendered = unknown if rendered is None else rendered.otherwise(unknown)
    asked = shown.withColumn("evaluation_request", rendered).drop(
        "shown_1", "shown_2", "prompt", "prompt_template", "category"
    )
    return _scored(asked, backend, wide)


def _scored(asked: DataFrame, backend: Backend, wide: bool) -> DataFrame:
    reviewed = _reviewed(asked, backend, ["request_id", "direction"])
    reviewed = reviewed.withColumn("_scores", parse_score_pair(F.col("review")))
    one, two = unswap_scores(F.col("direction"), F.col("_scores"))
    long = reviewed.select(
        "request_id",
        "request",
        "direction",
        "evaluation_request",
        F.col("review").alias("evaluation"),
        one.alias("score1"),
        two.alias("score2"),
    )
    return pivot_pair_scores(long) if wide else long


def pivot_list_orders(long: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """One row per request with three columns per order of presentation."""
    parts = ("evaluation_request", "evaluation", "order")
    columns = [
        F.max(F.when(F.col("perm_index") == i, F.col(c))).alias(f"{i}_{p}_{c}")
        for i, p in enumerate(all_orders(n))
        for c in parts
    ]
    return long.groupBy(key).agg(F.max("request").alias("request"), *columns)


def judge_list(
    tables: Sequence[DataFrame],
    backend: Backend,
    prompt: str,
    wide: bool = False,
    done: DataFrame | None = None,
) -> DataFrame:
    """Judge ``n`` answer tables in all ``n!`` orders of presentation.

    Requests whose text is in ``done`` are left out.
    """
    n = len(tables)
    judged = judge_list_by_criteria(tables, backend, {"general": prompt}, done).drop("criterion")
    return pivot_list_orders(judged, n) if wide else judged


def judge_list_by_criteria(
    tables: Sequence[DataFrame],
    backend: Backend,
    prompts: dict[str, str],
    done: DataFrame | None = None,
) -> DataFrame:
    """Judge ``n`` answer tables by every criterion in all ``n!`` orders of presentation.

    ``prompts`` has one instruction per criterion, with ``{num}`` and ``{num_str}`` for
    the number of answers. The tables are merged once; criteria and orders come after
    the shuffle. Requests whose text is in ``done`` are left out before the merge.
    """
    n = len(tables)
    tables = _unfinished(tables, done)
    instructions = {c: list_judge_instruction(p, n) for c, p in prompts.items()}
    shown = criteria_cross(permute_answers(align_n_answers(tables), n), instructions)
    asked = shown.withColumn(
        "evaluation_request", list_judge_prompt(F.col("request"), F.col("shown"), F.col("prompt"))
    ).drop("shown", "prompt")
    reviewed = _reviewed(asked, backend, ["request_id", "criterion", "perm_index"])
    order = F.when(F.col("error").isNotNull(), F.array_repeat(F.lit(FAILED), n)).otherwise(
        parse_order(F.col("review"), n)
    )
    return reviewed.select(
        "request_id",
        "request",
        "criterion",
        "perm_index",
        "permutation",
        "evaluation_request",
        F.col("review").alias("evaluation"),
        unpermute_order(F.col("permutation"), order).alias("order"),
    )
