"""Templates, messages, padding, and other helpers."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **fields: Column) -> Column:
    """A format template ({name}, {{ and }} for braces) with columns in place of its fields. Null fields are ""."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif m := re.fullmatch(r"\{(\w+)\}", piece):
            parts.append(F.coalesce(fields[m[1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def messages(prompt: Column, suffix: str = "", system: str | None = None, few_shot: list[tuple[str, str]] = ()) -> Column:
    """System message if any, the examples, then the prompt with its suffix."""
    head = ([message("system", F.lit(system))] if system else []) + [message(r, F.lit(c)) for r, c in few_shot]
    return F.array(*head, message("user", F.concat(F.coalesce(prompt, F.lit("")), F.lit(suffix))))


def chat_text(conversation: Column) -> Column:
    """Messages in the simple chat writing, open for the assistant's turn."""
    one = lambda m: F.concat(F.lit("<|start|>"), m["role"], F.lit("<|message|>"), m["content"], F.lit("<|end|>"))
    return F.concat(F.array_join(F.transform(conversation, one), ""), F.lit("<|start|>assistant"))


def padded(prompt: Column, tokens: Column, logprobs: Column, advantage: Column) -> Column:
    """Struct of input, target_tokens, logprobs and advantages of one length: zeros stand for all prompt tokens but one."""
    ahead = F.greatest(F.size(prompt) - 1, F.lit(0))
    zeros = lambda kind: F.array_repeat(F.lit(0).cast(kind), ahead)
    return F.struct(
        F.concat(prompt, F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))).alias("input"), F.concat(zeros("int"), tokens).alias("target_tokens"),
        F.concat(zeros("double"), logprobs).alias("logprobs"), F.concat(zeros("double"), F.array_repeat(advantage.cast("double"), F.size(tokens))).alias("advantages"),
    )


def zipped(*arrays: Column) -> Column:
    """Arrays side by side, as long as the shortest."""
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0]))


def text_parts(content: Column) -> Column:
    """The texts among typed parts, one a line."""
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def first_text(content: Column) -> Column:
    """The first text part, "" without one."""
    found = F.filter(content, lambda p: p["type"] == "text")
    return F.when(F.size(found) > 0, F.element_at(found, 1)["text"]).otherwise("")


def with_hidden(hidden: Column, content: Column) -> Column:
    """Hidden reasoning and content, parted by a blank line."""
    return F.when(F.length(hidden) > 0, F.concat(hidden, F.lit("\n\n"), content)).otherwise(content)


def hidden_length(hidden: Column) -> Column:
    """Characters of the hidden reasoning; null where there is none."""
    return F.nullif(F.length(hidden), F.lit(0))


def provider_of(key: Column) -> Column:
    """The key without its last _ part."""
    return F.regexp_replace(key, "_[^_]*$", "")


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def merged(*maps: Column) -> Column:
    """Maps merged; the entries of later ones win."""
    def over(first: Column, second: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)

    return functools.reduce(over, maps)
