"""Rewards as column builders: a reward takes (response, reference) columns and gives a DOUBLE column.

A null response or reference counts as "". Rewards combine by `combined`, which keeps a readable name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolloom.functions import extract as X


@dataclass(frozen=True)
class Reward:
    """A named reward."""

    name: str
    build: Callable[[Column, Column], Column]

    def __call__(self, response: Column, reference: Column) -> Column:
        return self.build(F.coalesce(response, F.lit("")), F.coalesce(reference, F.lit(""))).cast("double")


def _one(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _bonus(condition: Column, size: float = 0.1) -> Column:
    return F.when(condition, size).otherwise(-size)


#: The reference's number stands somewhere in the response; an empty reference gives 0.
exact_match = Reward("exact_match", lambda t, r: _one((X.normal_number(r) != "") & F.contains(X.normal_number(t), X.normal_number(r))))
#: The box holds the reference's number (its part after #### where it has one); no box gives 0, an empty box matches an empty reference.
boxed_match = Reward("boxed_match", lambda t, r: _one(F.coalesce(X.normal_number(X.boxed(t)) == X.after_hashes(X.normal_number(r)), F.lit(False))))
boxed_format_bonus = Reward("boxed_format_bonus", lambda t, r: _bonus(X.boxed(t).isNotNull()))
contains_reference = Reward("contains_reference", lambda t, r: _one((r != "") & F.contains(F.lower(t), F.lower(r))))
answer_tag_match = Reward("answer_tag_match", lambda t, r: _one(F.coalesce(X.normal_number(X.answer_tag(t)) == X.normal_number(r), F.lit(False))))
answer_tag_format_bonus = Reward("answer_tag_format_bonus", lambda t, r: _bonus(X.answer_tag(t).isNotNull()))


def _molecules(predicted: Column, reference: Column, cleaned: Column) -> Column:
    """Equal as molecules (the reference in its cleaned writing); as stripped texts, the reference as it stands, where either is none."""
    x, y = X.canonical_molecule(predicted), X.canonical_molecule(cleaned)
    return F.coalesce(x == y, X.strip(predicted) == X.strip(reference))


smiles_match = Reward("smiles_match", lambda t, r: _one(F.coalesce(_molecules(X.strip_latex(X.boxed(t)), r, X.strip_latex(r)), F.lit(False))))


def check_correct(predicted: Column, reference: Column) -> Column:
    """Whether a predicted molecule, without \\text, is the reference; an empty prediction is wrong."""
    return F.coalesce((predicted != "") & _molecules(X.text_only(predicted), reference, reference), F.lit(False))


def regex_match(pattern: str) -> Reward:
    """1 where the pattern is found; a dot matches line ends."""
    return Reward(f"regex_match({pattern})", lambda t, r: _one(t.rlike("(?s)" + pattern)))


def length_penalty(max_tokens: int = 512, penalty_per_token: float = 0.001) -> Reward:
    """Minus the penalty for each word beyond the limit; -0.0 within it."""
    return Reward("length_penalty", lambda t, r: F.lit(-penalty_per_token) * F.greatest(F.lit(0), F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0))) - max_tokens))


def combined(*weighted: tuple[float, Reward]) -> Reward:
    """Weighted sum, added from left to right; may be nested."""

    def build(t: Column, r: Column) -> Column:
        total = F.lit(0.0)
        for weight, reward in weighted:
            total = total + F.lit(float(weight)) * reward(t, r)
        return total

    return Reward(" + ".join(f"{w}*{r.name}" for w, r in weighted), build)


ALL = [exact_match, boxed_match, boxed_format_bonus, contains_reference, answer_tag_match, answer_tag_format_bonus, smiles_match]
