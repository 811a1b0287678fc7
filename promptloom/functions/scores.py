"""Scores and rankings in the text of a judge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.bind import bind

# Scores standing for an unreadable review and a failed call.
UNPARSABLE = -1
FAILED = -2
FAILED_REVIEW = "-2,-2"

# Fixed patterns.
NUMBER = (
    r"(?U)^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    r"|(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
)
PARENTHESISED = r"\(([\d]+\.*[\d]*), *([\d]+\.*[\d]*)\)"
CHAIN = r"(Assistant \d+( [>=] Assistant \d+)+)"


def parse_score_pair(review: Column) -> Column:
    """``array<double>`` of two scores.

    The first line must be two numbers with one comma or space between them;
    failing that, the text must hold exactly one ``(a, b)``. Otherwise both
    scores are -1. A pair like ``(8..5,9)`` that is no number gives nulls.
    """
    first_line = F.get(F.split(review, "\n", -1), F.lit(0))
    tokens = F.split(F.replace(first_line, F.lit(","), F.lit(" ")), " ", -1)
    one, two = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    left = F.regexp_extract_all(review, F.lit(PARENTHESISED), 1)
    right = F.regexp_extract_all(review, F.lit(PARENTHESISED), 2)

    def number(text: Column) -> Column:
        return F.trim(text).try_cast("double")

    return (
        F.when(
            (F.size(tokens) == 2) & one.rlike(NUMBER) & two.rlike(NUMBER),
            F.array(number(one), number(two)),
        )
        .when(F.size(left) != 1, F.array(F.lit(float(UNPARSABLE)), F.lit(float(UNPARSABLE))))
        .otherwise(F.array(number(F.get(left, F.lit(0))), number(F.get(right, F.lit(0)))))
    )


def score_status(first: Column, second: Column) -> Column:
    """``ok``, ``unparsable`` (-1 twice or null) or ``failed`` (-2 twice)."""
    return (
        F.when((first == FAILED) & (second == FAILED), "failed")
        .when(first.isNull() | second.isNull(), "unparsable")
        .when((first == UNPARSABLE) & (second == UNPARSABLE), "unparsable")
        .otherwise("ok")
    )


def parse_order(review: Column, n: int) -> Column:
    """``array<int>``: the place of every assistant in the judge's chain.

    Takes the first chain naming exactly ``n`` assistants. Places are
    competition ranks (1, 2, 2, 4); an assistant named twice keeps its later
    place, one not named gets 0, number 0 means the last one. No such chain,
    or a number above ``n``, gives -1 for all.
    """
    text = F.replace(
        F.replace(review, F.lit(">="), F.lit(">")), F.lit(">>"), F.lit(">")
    )
    chain = F.get(
        F.filter(
            F.regexp_extract_all(text, F.lit(CHAIN), 1),
            lambda c: F.size(F.regexp_extract_all(c, F.lit("Assistant"), 0)) == n,
        ),
        F.lit(0),
    )
    return F.coalesce(
        bind(chain, lambda c: _places(c, n)), F.array_repeat(F.lit(UNPARSABLE), n)
    )


def _places(chain: Column, n: int) -> Column:
    """Place by assistant, null if there is no chain or a number is above ``n``."""
    named = F.transform(
        F.regexp_extract_all(chain, F.lit(r"\d+"), 0), lambda d: d.try_cast("int")
    )

    def place(signs: Column, k: Column) -> Column:
        # one more than the number of assistants before the last ">" left of k
        return F.lit(1) + F.aggregate(
            F.slice(signs, F.lit(1), k),
            F.struct(F.lit(0).alias("seen"), F.lit(0).alias("ahead")),
            lambda acc, s: F.struct(
                (acc["seen"] + 1).alias("seen"),
                F.when(s == ">", acc["seen"] + 1).otherwise(acc["ahead"]).alias("ahead"),
            ),
            lambda acc: acc["ahead"],
        )

    placed = bind(
        F.regexp_extract_all(chain, F.lit("[>=]"), 0),
        lambda signs: F.transform(
            named,
            lambda a, k: F.struct(
                F.when(a == 0, F.lit(n)).otherwise(a).alias("who"),
                place(signs, k).alias("place"),
            ),
        ),
    )

    def place_of(entries: Column, m: Column) -> Column:
        mine = F.filter(entries, lambda p: p["who"] == m)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["place"], F.lit(0))

    return bind(
        placed,
        lambda entries: F.when(
            ~F.exists(entries, lambda p: p["who"].isNull() | (p["who"] > n)),
            F.transform(F.sequence(F.lit(1), F.lit(n)), lambda m: place_of(entries, m)),
        ),
    )
