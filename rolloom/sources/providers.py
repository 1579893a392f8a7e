"""Completions for prompts: from a table, or from any provider that answers texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions.extract import chain_cleaned
from rolloom.functions.helpers import fill

T = TypeVar("T")


class CompletionProvider(Protocol):
    """Anything that gives `n` replies to a prompt."""

    def complete(self, prompt: str, n: int) -> list[str]: ...


@dataclass(frozen=True)
class TableProvider:
    """The default: replies that exist as rows (key, sample_idx, response)."""

    rollouts: DataFrame
    key: str = "problem_id"

    def answer(self, prompts: DataFrame, n: int) -> DataFrame:
        """Prompts with their first `n` replies; a prompt without replies has none."""
        return prompts.join(self.rollouts.where(F.col("sample_idx") < n).select(self.key, "sample_idx", "response"), self.key)


def with_retries(call: Callable[[], T], tries: int = 3, wait: Callable[[float], None] = time.sleep, accept: Callable[[T], bool] = lambda x: True, otherwise: T = "") -> T:
    """The first accepted reply; faults and rejected replies are tried again after 1, 2, 4... seconds. At the end `otherwise` for rejected replies, or the fault."""
    for i in range(tries):
        fault = None
        try:
            reply = call()
            if accept(reply):
                return reply
        except Exception as e:  # the provider's own kinds
            fault = e
        if i + 1 < tries:
            wait(2.0**i)
    if fault:
        raise fault
    return otherwise


def complete(prompts: DataFrame, make: Callable[[], CompletionProvider], n: int, key: str = "problem_id", tries: int = 3, workers: int = 8, accept: Callable[[list[str]], bool] = lambda replies: True) -> DataFrame:
    """(key, sample_idx, response, elapsed_s, error): one provider for each task, each prompt asked once for `n` replies, `workers` prompts of a batch at a time.

    Faults, and replies that `accept` rejects (no answer in them, say), are tried again; elapsed_s is the time of the last try. A prompt that fails to the end gives one row with its error, and so does one whose
    replies are rejected to the end.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()

        def ask(prompt: str) -> tuple[list[str], float, str | None]:
            took = 0.0

            def once() -> list[str]:
                nonlocal took
                began = time.monotonic()
                try:
                    return provider.complete(prompt, n)
                finally:
                    took = time.monotonic() - began

            try:
                replies = with_retries(once, tries, accept=accept, otherwise=None)
            except Exception as e:
                return [], took, str(e)
            return (replies, took, None) if replies is not None else ([], took, "no accepted reply")

        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                out = []
                for k, (replies, took, error) in zip(batch[key], pool.map(ask, batch["prompt"])):
                    out += [(k, i, r, took, None) for i, r in enumerate(replies)] if error is None else [(k, 0, None, took, error)]
                yield pd.DataFrame(out, columns=[key, "sample_idx", "response", "elapsed_s", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, sample_idx int, response string, elapsed_s double, error string")


def answers_or_ask(rows: DataFrame, text: str, make: Callable[[], CompletionProvider] | None = None, template: str = "Give only the final answer of this solution, or NONE:\n{solution}", workers: int = 8) -> DataFrame:
    """Rows with `answer`: the cleaned box or final phrase of `text`, and where both are missing what a provider reads out of it; its NONE (in any case) and its faults give "".

    Only texts without an answer are sent to the provider; null and empty ones, and all without a provider, have "".
    """
    found = rows.withColumn("answer", F.coalesce(chain_cleaned(F.col(text)), F.lit("")))
    if make is None:
        return found

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            try:
                reply = next(iter(provider.complete(prompt, 1)), "") or ""
            except Exception:  # the provider's own kinds: no answer
                return ""
            return "" if reply.strip().upper() == "NONE" else reply.strip()

        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                yield pd.Series(list(pool.map(one, (None if pd.isna(x) else x for x in batch))), dtype=object)

    prompt = F.when((F.col("answer") == "") & (F.col(text) != ""), fill(template, solution=F.col(text)))
    return found.withColumn("answer", F.coalesce(ask(prompt), "answer"))
