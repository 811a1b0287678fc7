"""Prompt templates compiled once into Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the marker that hands the rest of a template to the assistant.
ROLE_SWITCH = "[ROLESWITCHING assistant:]"


def render_template(template: str, fields: Mapping[str, Column]) -> Column:
    """``template.format(**fields)`` as one concatenation.

    The template is parsed here, on the driver, so braces inside the data are
    never looked at again. A field that is not in ``fields`` is an error now
    rather than in a task.
    """
    parts: list[Column] = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in fields:
            raise KeyError(f"unknown template field {field!r}")
        if spec or conversion:
            raise ValueError(f"format options are not supported for field {field!r}")
        parts.append(fields[field])
    if not parts:
        return F.lit("")
    return F.concat(*parts) if len(parts) > 1 else parts[0].cast("string")


def split_role_switch(template: str) -> list[str]:
    """The user part of a template, then what the assistant is made to start with."""
    return template.split(ROLE_SWITCH)


def render_outline_prompt(template: str, request: Column) -> tuple[Column, Column]:
    """Question text and partial answer (null without a role switch)."""
    parts = split_role_switch(template)
    question = render_template(parts[0], {"request": request})
    if len(parts) == 1:
        return question, F.lit(None).cast("string")
    return question, render_template(parts[1], {"request": request})


def render_point_prompt(
    template: str, request: Column, outline: Column, point: Column, point_outline: Column
) -> tuple[Column, Column]:
    """Like :func:`render_outline_prompt` for one point; at most one role switch."""
    fields = {
        "request": request,
        "outline": outline,
        "point": point,
        "point_outline": point_outline,
    }
    parts = split_role_switch(template)
    if len(parts) > 2:
        raise ValueError("a point prompt may switch roles once")
    question = render_template(parts[0], fields)
    if len(parts) == 1:
        return question, F.lit(None).cast("string")
    return question, render_template(parts[1], fields)


# How a judge prompt spells the number of answers.
NUMBER_WORDS = {
    2: "two",
    3: "three",
    4: "four",
    5: "five",
    6: "six",
    7: "seven",
    8: "eight",
    9: "nine",
    10: "ten",
    20: "twenty",
}


def pair_judge_prompt(
    template: str, question: Column, answer_1: Column, answer_2: Column, prompt: Column
) -> Column:
    """A missing answer is judged as an empty one."""
    shown = {
        "answer_1": F.coalesce(answer_1, F.lit("")),
        "answer_2": F.coalesce(answer_2, F.lit("")),
    }
    return render_template(template, {"question": question, **shown, "prompt": prompt})


def list_judge_instruction(prompt: str, n: int) -> str:
    """The closing instruction with ``{num}`` and ``{num_str}`` filled in."""
    if n not in NUMBER_WORDS:
        raise ValueError(f"no number word for {n} answers")
    return prompt.format(num=n, num_str=NUMBER_WORDS[n])


def list_judge_prompt(question: Column, answers: Column, instruction: Column) -> Column:
    """Question, every answer in its numbered block, then the instruction.

    A missing answer has an empty block. The marks in brackets are fixed values.
    """
    blocks = F.transform(
        answers,
        lambda a, i: F.concat(
            F.lit("[Assistant "),
            (i + 1).cast("string"),
            F.lit("]\n"),
            F.coalesce(a, F.lit("")),
            F.lit("\n\n[End of Assistant "),
            (i + 1).cast("string"),
            F.lit("]"),
        ),
    )
    return F.concat(
        F.lit("[Question]\n"),
        question,
        F.lit("\n\n"),
        F.array_join(blocks, "\n\n"),
        F.lit("\n\n[System]\n"),
        instruction,
        F.lit("\n\n"),
    )
