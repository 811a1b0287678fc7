"""Message arrays: odd length, user and assistant in turn, user last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions.bind import bind


def as_messages(request: Column) -> Column:
    return F.array(request)


def is_request(messages: Column) -> Column:
    """True when the last message is the user's."""
    return F.size(messages) % 2 == 1


def checked_messages(messages: Column) -> Column:
    """The messages, or an error in the task for an even number of them."""
    return F.when(is_request(messages), messages).otherwise(
        F.raise_error(F.lit("a request needs an odd number of messages, the last one the user's"))
    )


def last_message(messages: Column) -> Column:
    return F.element_at(messages, -1)


def with_last(messages: Column, text: Column) -> Column:
    """History kept, last message replaced."""
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(text))


def with_partial(messages: Column, question: Column, partial: Column) -> Column:
    """Last message replaced, then the (possibly null) start of the answer."""
    return F.concat(F.slice(messages, 1, F.size(messages) - 1), F.array(question, partial))


def role_messages(messages: Column, system: Column) -> Column:
    """System message first; roles go by position, nulls leave afterwards."""
    turns = F.transform(
        messages,
        lambda m, i: F.struct(
            F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            m.alias("content"),
        ),
    )
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.concat(head, F.filter(turns, lambda t: t["content"].isNotNull()))


def joined_messages(messages: Column, mention: Column) -> Column:
    """``<@mention>`` and all non-null messages, one space between."""
    return F.concat(F.lit("<@"), mention, F.lit("> "), F.array_join(messages, " "))


@dataclass(frozen=True)
class ChatTemplate:
    system: str
    user: str
    assistant: str
    separator: str
    colon: bool


# Chat templates the local models were trained with.
CHAT_TEMPLATES = {
    "orca": ChatTemplate(
        system=(
            "### System:\nYou are an AI assistant that follows instruction extremely"
            " well. Help as much as you can.\n\n"
        ),
        user="### User:\n",
        assistant="### Response:\n",
        separator="\n\n",
        colon=False,
    ),
    "openchat": ChatTemplate(
        system=(
            "System: You are an AI assistant that follows instruction extremely well."
            " Help as much as you can.\n"
        ),
        user="Human",
        assistant="Assistant",
        separator="<|end_of_turn|>",
        colon=True,
    ),
    "ultra-lm": ChatTemplate(
        system=(
            "A chat between a curious user and an artificial intelligence assistant."
            " The assistant gives helpful, detailed, and polite answers to the user's"
            " questions."
        ),
        user="User",
        assistant="Assistant",
        separator="</s>",
        colon=True,
    ),
}


def chat_template_name(model_path: Column) -> Column:
    """Name of the first template whose mark is in the model path, else null."""
    return (
        F.when(model_path.contains("orca"), "orca")
        .when(model_path.contains("openchat"), "openchat")
        .when(F.lower(model_path).contains("ultralm"), "ultra-lm")
    )


def render_conversation(messages: Column, template: ChatTemplate) -> Column:
    """One prompt string: whole rounds, the question, an open answer slot.

    A message after the question is the partial answer and follows the slot
    directly. Empty messages are written as a bare role, like the open slot.
    """
    return bind(messages, lambda m: _conversation(m, template))


def _conversation(messages: Column, template: ChatTemplate) -> Column:
    after_role = ": " if template.colon else ""
    bare = ":" if template.colon else ""
    history = (F.floor((F.size(messages) - 1) / 2) * 2).cast("int")

    def turn(message: Column, i: Column) -> Column:
        role = F.when(i % 2 == 0, F.lit(template.user)).otherwise(F.lit(template.assistant))
        said = F.concat(role, F.lit(after_role), message, F.lit(template.separator))
        return F.when(F.coalesce(F.length(message), F.lit(0)) > 0, said).otherwise(
            F.concat(role, F.lit(bare))
        )

    rounds = F.array_join(F.transform(F.slice(messages, F.lit(1), history + 1), turn), "")
    opening = template.system + (template.separator if template.colon else "")
    partial = F.coalesce(F.get(messages, history + 1), F.lit(""))
    return F.concat(F.lit(opening), rounds, F.lit(template.assistant + bare), partial)


def render_by_template(messages: Column, name: Column) -> Column:
    """Pick among :data:`CHAT_TEMPLATES` per row."""
    chosen = None
    for key, template in CHAT_TEMPLATES.items():
        prompt = render_conversation(messages, template)
        chosen = F.when(name == key, prompt) if chosen is None else chosen.when(name == key, prompt)
    return chosen
