"""Backends by name.

A backend name fixes how messages are laid out for the service; the function
that talks to the service is given by the caller, who knows the address and
holds the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.messages import (
    CHAT_TEMPLATES,
    joined_messages,
    render_conversation,
    role_messages,
)
from promptloom.operators.generate import Call, PythonBackend


def role_layout(system: str) -> Callable[[Column], Column]:
    """Messages as JSON objects ``{"role", "content"}``, one array element each."""
    return lambda m: F.transform(role_messages(m, F.lit(system)), lambda t: F.to_json(t))


def chat_layout(template: str) -> Callable[[Column], Column]:
    """One prompt string in the model's own chat template."""
    if template not in CHAT_TEMPLATES:
        raise ValueError(f"unknown chat template {template!r}")
    return lambda m: F.array(render_conversation(m, CHAT_TEMPLATES[template]))


def mention_layout(user: str) -> Callable[[Column], Column]:
    """One line of text addressed to a chat user."""
    return lambda m: F.array(joined_messages(m, F.lit(user)))


LAYOUTS: dict[str, Callable[[str], Callable[[Column], Column]]] = {
    "openai": role_layout,
    "fastchat": chat_layout,
    "claude_slack": mention_layout,
}

# How long one call may take before it is tried again.
TIMEOUTS = {"claude_slack": 60.0}
WAIT_MIN = {"openai": 8.0, "claude_slack": 10.0}


def get_backend(
    name: str, layout: str, open_call: Callable[[], Call], **options
) -> tuple[Callable[[Column], Column], PythonBackend]:
    """The message layout and the backend registered under ``name``.

    ``layout`` is the system message, chat template or user to mention.
    """
    if name not in LAYOUTS:
        raise ValueError(f"unknown model name {name!r}")
    defaults: dict = {"timeout": TIMEOUTS.get(name), "wait_min": WAIT_MIN.get(name, 0.0)}
    if name == "fastchat":
        defaults.update(batch=True, attempts=1)
    return LAYOUTS[name](layout), PythonBackend(open=open_call, **{**defaults, **options})
