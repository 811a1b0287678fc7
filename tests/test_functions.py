"""Templates, messages and parsers, against small Python models written from
the description and against fixed cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from promptloom.functions import messages as M
from promptloom.functions.outline import dedupe_points, parse_points
from promptloom.functions.scores import parse_order, parse_score_pair, score_status
from promptloom.functions.template import (
    list_judge_instruction,
    render_outline_prompt,
    render_point_prompt,
    render_template,
)
from promptloom.functions.text import count_words, strip, truncate_stop, unescape_code
from promptloom.operators.pairing import all_orders, unpermute_order


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


def apply(spark, values, function, kind="string"):
    df = column(spark, values, kind).select("i", function(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


# ---- templates --------------------------------------------------------------


def test_data_is_never_a_template(spark):
    out = apply(
        spark,
        ["{outline} {", "}}"],
        lambda x: render_template("{{{request}}} {request}", {"request": x}),
    )
    assert out == ["{{outline} {} {outline} {", "{}}} }}"]


@pytest.mark.parametrize("template,error", [("{nobody}", KeyError), ("{request!r}", ValueError), ("{", ValueError)])
def test_bad_templates_fail_when_built(spark, template, error):
    with pytest.raises(error):
        render_template(template, {"request": F.lit("x")})


def test_role_switch(spark):
    marker = "[ROLESWITCHING assistant:]"
    df = spark.range(1)
    for template, want in [
        ("Q {request}", ("Q hi", None)),
        (f"Q {{request}}{marker} 1.", ("Q hi", " 1.")),
        (f"Q{marker}A {{request}}{marker}ignored {{nobody}}", ("Q", "A hi")),
    ]:
        question, partial = render_outline_prompt(template, F.lit("hi"))
        assert tuple(df.select(question, partial).first()) == want
    with pytest.raises(ValueError):
        render_point_prompt(f"a{marker}b{marker}c", *[F.lit("x")] * 4)


def test_number_words():
    assert list_judge_instruction("{num} is {num_str}", 20) == "20 is twenty"
    with pytest.raises(ValueError):
        list_judge_instruction("{num}", 11)


# ---- messages ---------------------------------------------------------------


def test_roles_are_given_before_nulls_leave(spark):
    out = apply(
        spark,
        [["a", None, "c", "d"]],
        lambda m: M.role_messages(m, F.lit("sys")),
        "array<string>",
    )
    assert [tuple(t) for t in out[0]] == [
        ("system", "sys"),
        ("user", "a"),
        ("user", "c"),
        ("assistant", "d"),
    ]


def test_even_requests_are_refused(spark):
    assert apply(spark, [["a"], ["a", "b", "c"]], M.checked_messages, "array<string>") == [["a"], ["a", "b", "c"]]
    with pytest.raises(Exception, match="odd number"):
        apply(spark, [["a", "b"]], M.checked_messages, "array<string>")


def test_conversation_prompts(spark):
    asked = [["hi"], ["hi", "ho", "hu"], ["hi", None], ["hi", " 1."], ["", "x", ""]]
    template = M.ChatTemplate("S", "U", "A", "|", True)
    out = apply(spark, asked, lambda m: M.render_conversation(m, template), "array<string>")
    assert out == [
        "S|U: hi|A:",
        "S|U: hi|A: ho|U: hu|A:",
        "S|U: hi|A:",
        "S|U: hi|A: 1.",
        "S|U:A: x|U:A:",
    ]
    bare = M.ChatTemplate("S", "U\n", "A\n", "\n\n", False)
    out = apply(spark, asked[:2], lambda m: M.render_conversation(m, bare), "array<string>")
    assert out == ["SU\nhi\n\nA\n", "SU\nhi\n\nA\nho\n\nU\nhu\n\nA\n"]


def test_model_names(spark):
    paths = ["orca_mini", "openchat", "openchat-orca", "Orca", "TheUltraLM-13B", "llama"]
    assert apply(spark, paths, M.chat_template_name) == [
        "orca",
        "openchat",
        "orca",
        None,
        "ultra-lm",
        None,
    ]


# ---- text -------------------------------------------------------------------


def test_strip_and_words(spark):
    texts = ["  a b ", "\t\n x ", "", " ", "\x1ca\x1f", "a\n\nb  c", "​z"]
    assert apply(spark, texts, strip) == [t.strip() for t in texts]
    plain = ["  a b ", "", " ", "a\n\nb  c"]
    assert apply(spark, plain, count_words) == [len(t.split()) for t in plain]


def test_truncate_stop(spark):
    texts = ["a</s>b</s>c", "none", "</s>", "äö</s>ü", "x</s></s>"]
    want = [t[: t.rfind("</s>")] if "</s>" in t else t for t in texts]
    assert apply(spark, texts, lambda x: truncate_stop(x, "</s>")) == want


def test_unescape_code(spark):
    texts = ["a\\_b", "x\\_\n```a\\_b\n```c\\_d", "x\n```a\\_b", "q\n```r\\_\n```s\\_\n```t\\_\n```u\\_"]
    assert apply(spark, texts, unescape_code) == [
        "a\\_b",
        "x\\_\n```a_b\n```c\\_d",
        "x\n```a\\_b",
        "q\n```r_\n```s\\_\n```t_\n```u\\_",
    ]


# ---- outlines ---------------------------------------------------------------


def points_model(outline):
    """A number and a dot, one white space at most, one character of any kind,
    then the rest of that line."""
    found, at = [], 0
    while match := re.compile(r"(\d+)\.").search(outline, at):
        start = match.end()
        if start + 1 < len(outline) and outline[start].isspace():
            start += 1
        if start >= len(outline):
            # a lone last character may be the white space itself
            break
        end = outline.find("\n", start + 1)
        end = len(outline) if end < 0 else end
        found.append((match.group(1), outline[start:end]))
        at = end
    return found


def test_points_of_random_outlines(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("12. \nab") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    out = apply(spark, texts, parse_points)
    for text, points in zip(texts, out):
        assert [tuple(p) for p in points] == points_model(text), repr(text)


def test_point_cases(spark):
    cases = {
        "1. One\n2. Two": [("1", "One"), ("2", "Two")],
        "v2.0 x": [("2", "0 x")],
        "1.\n2. Foo": [("1", "2. Foo")],
        "01. a \n1. b\n01. c": [("01", "a "), ("1", "b")],
        "٣. arabic": [("٣", "arabic")],
        "no points": [],
        "1.": [],
    }
    out = apply(spark, list(cases), lambda x: dedupe_points(parse_points(x)))
    assert [[tuple(p) for p in points] for points in out] == list(cases.values())


# ---- scores -----------------------------------------------------------------


def scores_model(review):
    number = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)")
    tokens = review.split("\n")[0].replace(",", " ").split(" ")
    if len(tokens) == 2 and all(number.fullmatch(t) for t in tokens):
        return [float(t) for t in tokens]
    found = re.findall(r"\((\d+\.*\d*), *(\d+\.*\d*)\)", review)
    if len(found) != 1:
        return [-1.0, -1.0]
    return [float(t) if number.fullmatch(t) else None for t in found[0]]


def test_scores_of_random_reviews(spark):
    rng = random.Random(11)
    pieces = ["8", "9", "7.5", " ", ",", "(", ")", "\n", ".", "(8,9)", "(7, 6)", "a", "-"]
    reviews = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    out = apply(spark, reviews, parse_score_pair)
    for review, scores in zip(reviews, out):
        assert scores == scores_model(review), repr(review)


def test_score_cases(spark):
    cases = {
        "8 9\nwell": [8.0, 9.0],
        "8,9": [8.0, 9.0],
        "8, 9": [-1.0, -1.0],
        "8 9 ": [-1.0, -1.0],
        "So (8, 9.5)!": [8.0, 9.5],
        "(8,9)(7,6)": [-1.0, -1.0],
        "(8..5,9)": [None, 9.0],
        "-2,-2": [-2.0, -2.0],
        "8d 9f": [-1.0, -1.0],
        "inf -1e3": [float("inf"), -1000.0],
        "": [-1.0, -1.0],
    }
    assert apply(spark, list(cases), parse_score_pair) == list(cases.values())
    status = [
        tuple(r)[0]
        for r in spark.createDataFrame(
            [(8.0, 9.0), (-1.0, -1.0), (-2.0, -2.0), (None, 9.0)], "a double, b double"
        )
        .select(score_status(F.col("a"), F.col("b")))
        .collect()
    ]
    assert status == ["ok", "unparsable", "failed", "unparsable"]


def order_model(review, n):
    text = review.replace(">=", ">").replace(">>", ">")
    chains = [m.group(0) for m in re.finditer(r"Assistant \d+(?: [>=] Assistant \d+)+", text)]
    chains = [c for c in chains if c.count("Assistant") == n]
    if not chains:
        return [-1] * n
    who = [int(d) for d in re.findall(r"\d+", chains[0])]
    if max(who) > n:
        return [-1] * n
    signs, places, rank = re.findall("[>=]", chains[0]), [0] * n, 1
    for k, w in enumerate(who):
        if k and signs[k - 1] == ">":
            rank = k + 1
        places[(w or n) - 1] = rank
    return places


@pytest.mark.parametrize("n", [2, 3, 4])
def test_orders_of_random_reviews(spark, n):
    rng = random.Random(n)
    reviews = []
    for _ in range(800):
        names = [f"Assistant {rng.randint(0, n + (rng.random() < 0.1))}" for _ in range(n)]
        text = names[0]
        for name in names[1:]:
            text += rng.choice([" > ", " = ", " >= ", " >> ", " > ", ", "]) + name
        reviews.append(rng.choice(["", "I think: ", "Assistant 1 > Assistant 2\n"]) + text)
    out = apply(spark, reviews, lambda x: parse_order(x, n))
    for review, places in zip(reviews, out):
        assert places == order_model(review, n), repr(review)


def test_order_cases(spark):
    cases = {
        "Assistant 1 > Assistant 2 = Assistant 3 > Assistant 4": [1, 2, 2, 4],
        "Assistant 2 > Assistant 2 > Assistant 0 > Assistant 1": [4, 2, 0, 3],
        "Assistant 1 > Assistant 2 > Assistant 3 > Assistant 5": [-1] * 4,
        "Assistant 1 > Assistant 2 > Assistant 3 > Assistant 99999999999": [-1] * 4,
        "Assistant 1 > Assistant 2": [-1] * 4,
        "": [-1] * 4,
    }
    assert apply(spark, list(cases), lambda x: parse_order(x, 4)) == list(cases.values())


def test_orders_and_back():
    orders = all_orders(3)
    assert orders == [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    with pytest.raises(ValueError):
        all_orders(8)


def test_unpermute(spark):
    df = spark.createDataFrame([([2, 0, 1], [5, 6, 7])], "p array<int>, o array<int>")
    # shown first was table 2, then 0, then 1
    assert df.select(unpermute_order(F.col("p"), F.col("o"))).first()[0] == [6, 7, 5]
