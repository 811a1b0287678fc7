"""Answer tables side by side, in every order a judge shall see them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.bind import bind
from promptloom.operators.skew import ROWS_PER_TASK, added, find_hot_keys, join_spread, running

# The questions a list-wise judge can be asked.
CRITERIA = ("general", "relevance", "diversity", "coherence", "immersion", "integrity")

MAX_PERMUTED = 7


def number_occurrences(
    answers: DataFrame,
    order: Sequence[str] = ("request_id",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``occurrence`` 1, 2, … among the rows of one request text.

    For answer tables that do not share row ids. A text that fills much of the
    table is counted range by range.
    """
    return running(
        answers,
        ["request"],
        order,
        "occurrence",
        F.count,
        F.lit(1),
        added,
        find_hot_keys(answers, ["request"], rows_per_task),
    )


def merge_answers(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Row by row: ``on``, ``request`` and one column ``answer_1``, … per table.

    ``on`` identifies a row in every table: ``["request_id"]`` when they come
    from one request table, else ``["request", "occurrence"]`` after
    :func:`number_occurrences`. A missing or doubled row, or another request
    text, fails the job before anything is judged.

    One shuffle for any number of tables, and its partitioning by ``on`` still
    holds for what follows. Each aggregate keeps one value per table, so the
    state of a group does not grow with the data; rows are unique, so combining
    before the shuffle would only sort everything once more.
    """
    n = len(tables)
    union = None
    for i, table in enumerate(tables):
        part = table.select(
            *on, F.col("request").alias("_r"), "response", F.lit(i).alias("answer_idx")
        )
        union = part if union is None else union.unionByName(part)
    here = [F.col("answer_idx") == i for i in range(n)]
    merged = (
        union.repartition(*on)
        .groupBy(*on)
        .agg(
            F.min("_r").alias("_first"),
            F.max("_r").alias("_last"),
            *[F.count(F.when(here[i], 1)).alias(f"_n{i}") for i in range(n)],
            *[F.max(F.when(here[i], F.col("response"))).alias(f"answer_{i + 1}") for i in range(n)],
        )
    )
    complete = F.col("_first").eqNullSafe(F.col("_last"))
    for i in range(n):
        complete = complete & (F.col(f"_n{i}") == 1)
    return merged.select(
        *[c for c in on if c != "request"],
        F.when(complete, F.col("_first"))
        .otherwise(F.raise_error(F.lit("the answer tables differ in rows or requests")))
        .alias("request"),
        *[f"answer_{i + 1}" for i in range(n)],
    )


def pair_answers(first: DataFrame, second: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two tables row by row: ``on``, ``request``, ``answer_1``, ``answer_2``."""
    return merge_answers([first, second], on)


def align_n_answers(tables: Sequence[DataFrame], key: str = "request_id") -> DataFrame:
    """``key, request, answers`` with one answer per table, in table order."""
    if len(tables) < 2:
        raise ValueError("at least two answer tables are needed")
    merged = merge_answers(tables, [key])
    answers = F.array(*[f"answer_{i + 1}" for i in range(len(tables))])
    return merged.select(key, "request", answers.alias("answers"))


def swap_directions(pairs: DataFrame) -> DataFrame:
    """Every pair twice: ``direction`` 1 as it is, 2 with the answers swapped."""
    shown = F.array(
        F.struct(
            F.lit(1).alias("direction"),
            F.col("answer_1").alias("shown_1"),
            F.col("answer_2").alias("shown_2"),
        ),
        F.struct(
            F.lit(2).alias("direction"),
            F.col("answer_2").alias("shown_1"),
            F.col("answer_1").alias("shown_2"),
        ),
    )
    rest = [c for c in pairs.columns if c not in {"answer_1", "answer_2"}]
    return pairs.select(*rest, F.inline(shown))


def unswap_scores(direction: Column, scores: Column) -> tuple[Column, Column]:
    """Scores of answer 1 and answer 2, whichever was shown first."""
    one, two = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return (
        F.when(direction == 1, one).otherwise(two),
        F.when(direction == 1, two).otherwise(one),
    )


def all_orders(n: int) -> list[tuple[int, ...]]:
    """All orders of ``n`` answers in lexicographic order."""
    if n > MAX_PERMUTED:
        raise ValueError(f"{n} answers would be judged in more than 5,040 orders each")
    return list(permutations(range(n)))


def permute_answers(aligned: DataFrame, n: int) -> DataFrame:
    """Every row once per order: ``perm_index``, ``permutation``, ``shown``."""
    orders = F.lit([list(p) for p in all_orders(n)])
    return (
        aligned.select("*", F.posexplode(orders).alias("perm_index", "permutation"))
        .withColumn("shown", F.expr("transform(permutation, j -> answers[j])"))
        .drop("answers")
    )


def unpermute_order(permutation: Column, order: Column) -> Column:
    """Places by answer table instead of by order shown."""
    return bind(
        order,
        lambda places: F.transform(
            F.sequence(F.lit(0), F.size(permutation) - 1),
            lambda i: F.get(places, (F.array_position(permutation, i) - 1).cast("int")),
        ),
    )


def criteria_cross(df: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """Every row once per criterion, with the criterion's prompt."""
    unknown = set(prompts) - set(CRITERIA)
    if unknown:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    table = F.array(
        *[
            F.struct(F.lit(c).alias("criterion"), F.lit(p).alias("prompt"))
            for c, p in prompts.items()
        ]
    )
    return df.select("*", F.inline(table))


def template_lookup(
    questions: DataFrame,
    categories: DataFrame,
    templates: DataFrame,
    row_key: Sequence[str] = ("request_id",),
    default: str = "general",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the judge prompt and template of the question's category.

    A category without templates uses ``default``'s; a question without a
    category, or with two, fails the job. The category table grows with the questions and is
    joined by shuffle, with hot texts spread; the templates are broadcast when
    a bounded count shows they are few.
    """
    known = templates.select("category", "prompt", "prompt_template")
    fallback = known.where(F.col("category") == default).select(
        F.first("prompt").alias("prompt"), F.first("prompt_template").alias("prompt_template")
    ).first()
    hot = find_hot_keys(questions, ["request"], rows_per_task)
    # a question listed twice with one category is listed once
    single = categories.groupBy("request").agg(
        F.min("category").alias("category"), F.max("category").alias("_other")
    )
    with_category = join_spread(questions, single, ["request"], "left", row_key, hot)
    checked = with_category.withColumn(
        "category",
        F.when(F.col("category") == F.col("_other"), F.col("category"))
        .when(
            F.col("category").isNull(),
            F.raise_error(F.concat(F.lit("not in the prompt file: "), F.col("request"))),
        )
        .otherwise(F.raise_error(F.concat(F.lit("two categories for: "), F.col("request")))),
    ).drop("_other")
    missing = F.raise_error(F.concat(F.lit("no judge template for category "), F.col("category")))
    return checked.join(known, "category", "left").withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(fallback[c]).cast("string"), missing)
            for c in ("prompt", "prompt_template")
        }
    )


def split_route(
    requests: DataFrame, label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Requests to answer plainly (label 0) and requests to outline first."""
    plain = F.col(label).eqNullSafe(0)
    return requests.where(plain).drop(label), requests.where(~plain).drop(label)
