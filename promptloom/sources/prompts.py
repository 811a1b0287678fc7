"""Prompt files: small JSON objects, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


def read_prompt_file(spark: SparkSession, path: str) -> dict[str, str]:
    """All templates in a JSON file, from any file system Spark can read."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def naive_template(spark: SparkSession, prompt_file: str | None = None) -> str:
    """The ``prompt`` of a file; without one the question is asked as it is."""
    if prompt_file is None or prompt_file == "none":
        return "{request}"
    return read_prompt_file(spark, prompt_file)["prompt"]


@dataclass(frozen=True)
class OutlinePrompts:
    outline_prompt: str
    point_prompt: str


def outline_templates(
    spark: SparkSession,
    prompt_file: str | None = None,
    outline_prompt: str | None = None,
    point_prompt: str | None = None,
) -> OutlinePrompts:
    """Either a file or both templates, not a mixture."""
    if prompt_file is not None:
        if outline_prompt is not None or point_prompt is not None:
            raise ValueError("give either prompt_file or the two prompts, not both")
        prompts = read_prompt_file(spark, prompt_file)
        return OutlinePrompts(prompts["outline_prompt"], prompts["point_prompt"])
    if outline_prompt is None or point_prompt is None:
        raise ValueError("give either prompt_file or both outline_prompt and point_prompt")
    return OutlinePrompts(outline_prompt, point_prompt)
