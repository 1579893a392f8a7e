"""Rollout analytics on Spark: DataFrame operators for the data side of policy training and evaluation."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_HOMES = {
    "rolloom.sources.loaders": ("load_problems", "read_runs", "read_results", "load_dataset", "done_ids"),
    "rolloom.sources.sinks": ("append_metrics", "write_document", "write_documents", "write_array", "write_dual", "write_split"),
    "rolloom.sources.providers": ("CompletionProvider", "TableProvider", "answers_or_ask", "complete"),
    "rolloom.functions.rewards": ("Reward", "answer_tag_format_bonus", "answer_tag_match", "boxed_format_bonus", "boxed_match", "combined", "contains_reference", "exact_match", "length_penalty", "regex_match", "smiles_match"),
    "rolloom.functions.tokens": ("decoded", "rendered", "token_ids"),
    "rolloom.operators.trainer": ("Config", "MetricsLog", "Trainer", "samples_table"),
    "rolloom.operators.documents": ("reaction_report", "reaction_results", "repeat_documents", "run_documents"),
    "rolloom.operators.grpo": ("advantages", "batches", "datums", "step_metrics", "with_signal"),
}
_WHERE = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(_WHERE[name]), name)
