"""Answers out of replies, and their normal writings. All builders take and give columns.

Several definitions of "the answer" coexist; each is an operator of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The patterns that define the operators.
FLAT_BOX = r"\\boxed\{([^}]+)\}"
ANSWER_TAG = r"(?iduU)\*\*ANSWER:\s*([^\n]+?)\*\*"
FINAL_PHRASE = r"(?iduU)(?:final answer|the answer)(?:\s+is)?[:\s]+([^\n.]+)"
PROBLEM_BLOCK = r"(?sU)===\s*PROBLEM\s+START\s*===\s*\n(.*?)\n\s*===\s*PROBLEM\s+END\s*==="
NUMERIC = r"(?U)^[+-]?\d+([.,]\d+)?(/\d+)?$"
NO_ANSWER_SHOWN = "(no answer extracted)"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} with balanced braces, stripped; null without a box or where its brace is never closed.

    An empty box gives "". Null gives null.
    """
    rest = F.split(F.substring_index(text, "\\boxed{", -1), "")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(s["depth"] == 0, 0).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["depth"] > 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    closed = F.aggregate(rest, start, step, lambda s: s["end"])
    content = F.when(closed > 0, F.array_join(F.slice(rest, 1, F.greatest(closed - 1, F.lit(0))), ""))
    return F.when(F.instr(text, "\\boxed{") > 0, strip(content))


def boxed_or_empty(text: Column) -> Column:
    """Like `boxed`, with "" where there is none; null stays null."""
    return F.when(text.isNotNull(), F.coalesce(boxed(text), F.lit("")))


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def flat_boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} up to its first closing brace, stripped; null without one."""
    return strip(_last(text, FLAT_BOX))


def answer_tag(text: Column) -> Column:
    """Content of the last **ANSWER: ...** in any case, stripped; null without one."""
    return strip(_last(text, ANSWER_TAG))


def final_phrase(text: Column) -> Column:
    """What follows the first "final answer is" or "the answer", up to a full stop or line end, stripped; null without one."""
    return F.when(text.rlike(FINAL_PHRASE), strip(F.regexp_extract(text, FINAL_PHRASE, 1)))


def chain_tag_first(text: Column) -> Column:
    """Tag, else flat box, else phrase, else ""."""
    return F.when(text.isNotNull(), F.coalesce(answer_tag(text), flat_boxed(text), final_phrase(text), F.lit("")))


def chain_box_first(text: Column) -> Column:
    """Balanced box if not empty, else tag, else phrase, else ""."""
    return F.when(text.isNotNull(), F.coalesce(F.nullif(boxed(text), F.lit("")), answer_tag(text), final_phrase(text), F.lit("")))


def chain_cleaned(text: Column) -> Column:
    """Balanced box, cleaned (raw where cleaning leaves nothing), else phrase, else ""."""
    raw = F.nullif(boxed(text), F.lit(""))
    return F.when(text.isNotNull(), F.coalesce(F.nullif(clean_boxed(raw), F.lit("")), raw, final_phrase(text), F.lit("")))


def reject_placeholder(answer: Column) -> Column:
    """"" for an answer with both < and >."""
    return F.when(F.contains(answer, F.lit("<")) & F.contains(answer, F.lit(">")), "").otherwise(answer)


def chain_cleaned_checked(text: Column) -> Column:
    return reject_placeholder(chain_cleaned(text))


def chain_display(text: Column) -> Column:
    """Tag, else balanced box, else a note."""
    return F.coalesce(answer_tag(text), boxed(text), F.lit(NO_ANSWER_SHOWN))


def problem_block(text: Column) -> Column:
    """First non-empty block between the START and END lines, stripped; null without one."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PROBLEM_BLOCK), F.lit(1)), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def is_numeric(answer: Column) -> Column:
    """Signed whole number, with at most one decimal part and one denominator."""
    return answer.rlike(NUMERIC)


def _each_once(parts: pd.Series, write: Callable[[str], str]) -> pd.Series:
    """`write` of each distinct value of a batch; nulls stay."""
    values = parts.dropna().unique()
    return parts.map(dict(zip(values, map(write, values)))).astype(object).where(parts.notna(), None)


def _shortest(text: str) -> str:
    """The shortest writing of a text's double, without a point where it is whole; a text that stands for no finite double stays."""
    try:
        double = float(text)
    except ValueError:
        return text
    if not math.isfinite(double):
        return text
    return "0" if double == 0 else f"{double:.0f}" if double.is_integer() else repr(double)


@F.pandas_udf(StringType())
def _doubles(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield _each_once(s, _shortest)


def normal_number(text: Column) -> Column:
    """Commas, blanks and trailing full stops dropped; a number in the shortest writing of its double, whole ones as integers.

    Plain decimals of up to 15 digits are written by native expressions; only other texts with a digit (or nan, inf) pass through Python. Null gives null.
    """
    plain = F.regexp_replace(strip(F.translate(text, ", ", "")), r"\.+$", "")
    simple = r"^[+-]?(?=[\d.]{1,15}$)(?:\d+(?:\.\d+)?|\.\d+)$"
    digits = F.regexp_replace(plain, r"^[+-]?0*(?=\d)", "")
    digits = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^[+-]?", ""), r"^0+(?=\d)", ""), r"^(\d*)\.(\d*?)0*$", "$1.$2")
    digits = F.regexp_replace(F.regexp_replace(digits, r"\.$", ""), r"^(?=\.|$)", "0")
    native = F.when(plain.rlike(simple) & ~plain.rlike(r"^[+-]?0*\.0{3}"), F.concat(F.when(plain.startswith("-") & (digits.rlike("[1-9]")), "-").otherwise(""), digits))
    other = F.when(native.isNull() & plain.rlike(r"(?iU)\d|^[+-]?(nan|inf|infinity)$"), plain)
    return F.coalesce(native, _doubles(other), plain)


# The LaTeX writings that cleaning takes out of a box.
LATEX_NOISE = r"\\(?:displaystyle|bigl?|Bigl?|bigr?|Bigr?|left|right|text\{[^}]*\}|lfloor|rfloor|,|;| )"


def clean_boxed(raw: Column) -> Column:
    """The text after the last =, without LaTeX noise, as a normal number; "" where nothing is left."""
    return normal_number(strip(F.regexp_replace(F.substring_index(raw, "=", -1), LATEX_NOISE, "")))


#: A plain number, or a ratio of whole ones; neither exponent nor plus sign.
_RATIO = re.compile(r"(?P<above>-?\d+)/(?P<below>\d+)|-?(?:\d+\.?\d*|\.\d+)")


def _significant(text: str) -> str:
    """A number or ratio to ten significant digits; other texts stay."""
    found = _RATIO.fullmatch(text)
    if not found:
        return text
    try:
        return "%.10g" % (float(text) if found["below"] is None else int(found["above"]) / int(found["below"]))
    except (ZeroDivisionError, OverflowError):
        return text


@F.pandas_udf(StringType())
def _ten_digits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield _each_once(s, _significant)


def gate_answer(answer: Column) -> Column:
    """For the numeric gate only: lower case, LaTeX signs and white space out, comma as point, numbers and fractions to ten digits."""
    plain = F.regexp_replace(F.translate(F.lower(strip(answer)), "\\${}", ""), r"(?U)\s+", "")
    point = F.replace(plain, F.lit(","), F.lit("."))
    # whole numbers of up to ten digits stay but for zeros in front; what holds no digit stays too
    whole = F.when(point.rlike(r"^-?[0-9]{1,10}$"), F.regexp_replace(point, r"^(-?)0+(?=[0-9])", "$1"))
    return F.coalesce(whole, _ten_digits(F.when(whole.isNull() & point.rlike(r"(?U)\d"), point)), point)


def strip_latex(text: Column) -> Column:
    """\\text{x}, \\mathrm{x} and the like as x; thin spaces out."""
    text = F.regexp_replace(strip(text), r"\\(?:text|texttt|textbf|mathrm|mathtt)\{([^}]*)\}", "$1")
    return strip(F.replace(text, F.lit("\\,"), F.lit("")))


def text_only(text: Column) -> Column:
    """\\text{x} as x."""
    return F.regexp_replace(text, r"\\text\{([^}]*)\}", "$1")


def after_hashes(reference: Column) -> Column:
    """A reference's value: normal number of the text after the last ####."""
    return normal_number(F.substring_index(reference, "####", -1))


def _chemistry() -> Callable[[str], str | None] | None:
    """Canonical form of one component; null for a text that is no molecule. None without a chemistry library."""
    try:
        from rdkit import Chem
    except ImportError:
        return None

    def form(text: str) -> str | None:
        try:
            return Chem.MolToSmiles(Chem.MolFromSmiles(text))
        except Exception:  # the library's own kinds: no molecule
            return None

    return form


@F.pandas_udf(ArrayType(StringType()))
def _component_forms(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    form = _chemistry()
    for components in rows:
        yield components.map(lambda c: None if c is None or form is None else [form(x) for x in c])


def canonical_molecule(text: Column) -> Column:
    """Canonical form of a SMILES text, components sorted; null where a component is no molecule, or without a chemistry library."""
    forms = _component_forms(F.transform(F.split(text, r"\."), strip))
    return F.when(~F.exists(forms, lambda x: x.isNull()), F.array_join(F.array_sort(forms), "."))
