"""Canonical writing of texts and answers, as native column expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, with what they look like.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Ё": "e", "Н": "h", "І": "i", "Ї": "i", "Ј": "j", "К": "k", "Ӏ": "l", "М": "m", "О": "o", "Р": "p", "Ѕ": "s", "Т": "t", "У": "y", "Ү": "y", "Х": "x", "Ԝ": "w",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ε": "e", "η": "n", "ω": "w", "γ": "y",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "−": "-", "–": "-", "—": "-", "‐": "-", "‑": "-", "‒": "-", "﹣": "-", "－": "-", "⁄": "/", "∕": "/", "⧸": "/", "÷": "/", "٫": ".", "․": ".", "。": ".", "‚": ",", "，": ",", "٬": ",", "、": ",", "；": ";", "：": ":", "꞉": ":", "∶": ":", "＝": "=", "＋": "+",
}


@functools.cache
def _fold_table() -> tuple[str, str]:
    """From and to strings for `translate`: look-alikes, and by rule every character that decomposes to one ASCII character."""
    table = dict(LOOK_ALIKE)
    for code in range(0x80, 0x1FFFF):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0x3400 <= code <= 0xD7FF or ch in table:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != ch:
            plain = LOOK_ALIKE.get(plain, plain)
            if ord(plain) < 0x80 and plain != " ":
                table[ch] = plain.lower()
    source = "".join(k for k in table if ord(k) < 0x10000)
    return source, "".join(table[k] for k in source)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it (inside lambdas too)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case, accents and compatibility forms folded, look-alike characters as ASCII, marks, zero-width characters and quoting > of lines dropped, spaces plain.

    Null stays null.
    """
    source, target = _fold_table()
    plain = F.regexp_replace(text, r"(?m)^[ \t]*>+[ \t]?", "")
    folded = F.regexp_replace(F.translate(F.lower(F.translate(plain, source, target)), source, target), r"[\p{M}\p{Cf}]+", "")
    # looking characters up is slow, and ASCII texts need none
    return F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(plain)), r"[\s\p{Z}\u0085]+", " ")


def _strip_marks(text: Column) -> Column:
    """Math delimiters, emphasis, quotes and the commands \\boxed and \\text without their braces."""
    text = F.regexp_replace(text, r"\\(?:boxed|fbox|text|textbf|mathrm|mathbf|left|right|displaystyle)\b", "")
    text = F.regexp_replace(text, r"\\[()\[\],;:! ]", "")
    text = F.regexp_replace(text, r"\\d?frac\s?\{([^{}]*)\}\s?\{([^{}]*)\}", "$1/$2")
    text = F.regexp_replace(text, r"\{,\}", ",")
    return F.regexp_replace(text, "[$*`\"'\\u2018-\\u201f\\u00ab\\u00bb\\u2039\\u203a\\u300c-\\u300f{}~\\\\]+", "")


def _ungroup(text: Column) -> Column:
    """Digit groups of three joined: a comma, blank, apostrophe or underscore between them is writing only."""
    return F.regexp_replace(text, r"(?<![\d.,_])(?<!\d[ ,_])(\d{1,3})((?:[,_ ]\d{3})+)(?![\d_])(?![,_ ]\d{3}(?!\d))", "$1\u0001$2\u0002")


def _joined(text: Column) -> Column:
    """Numbers marked by `_ungroup` without their separators."""
    tail = lambda part: F.when(F.instr(part, "\u0001") > 0, F.regexp_replace(F.substring_index(part, "\u0001", -1), "[,_ ]", "")).otherwise(F.lit(""))
    return F.array_join(F.transform(F.split(_ungroup(text), "\u0002"), lambda part: F.concat(F.substring_index(part, "\u0001", 1), tail(part))), "")


def _content(text: Column) -> Column:
    """What remains of a value: letters, digits, signs, decimal points, fraction bars, and | between components."""
    text = F.regexp_replace(text, r"(?<=\d) ?/ ?(?=[-+]?\d)", "\u0003")
    text = F.regexp_replace(text, r"(?<=\d)\.(?=\d)|(?<![\p{L}\d])\.(?=\d)", "\u0004")
    text = F.regexp_replace(text, r"(?<!\p{L})- ?(?=[\d\u0004(])|(?<=[=:<>]) ?- ?(?=[\p{L}])", "\u0005")
    text = F.regexp_replace(text, r"(?<=[\d)\]]) ?[,;|] ?(?=[\d(\[\u0004\u0005])", "\u0006")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\u0003-\u0006=<>+^%]+", "")
    return F.translate(text, "\u0003\u0004\u0005\u0006", "/.-|")


def canonical_answer(answer: Column) -> Column:
    """One writing for all writings of an answer.

    Left aside: whitespace, case, punctuation, wrapping marks, digit grouping, look-alike characters, the order of named
    fields (`x = 1, y: 2`). Kept: sign, decimal point, fraction bar, the order of unnamed components. Null gives null; an answer of
    marks only gives "".
    """
    return let(F.trim(_strip_marks(fold(answer))), _canonical_plain)


def _canonical_plain(plain: Column) -> Column:
    # a comma inside brackets parts components, elsewhere it may group digits
    bracketed = plain.rlike(r"^[(\[].*[,;].*[)\]]\W*$")
    return let(F.when(bracketed, F.regexp_replace(plain, ",(?! )", ", ")).otherwise(_joined(plain)), _fields_or_content)


def _fields_or_content(plain: Column) -> Column:
    one = lambda f: F.concat(F.regexp_extract(f, r"^([a-z][a-z_0-9]*)", 1), F.lit("="), _content(F.regexp_replace(f, r"^[a-z][a-z_0-9]*\s*[:=]\s*", "")))
    named = lambda fields: F.forall(fields, lambda f: f.rlike(r"^[a-z][a-z_0-9]*\s*[:=]\s*\S.*$"))
    split = F.split(plain, r"\s*[,;\n]\s*|\s+and\s+|\s+(?=[a-z][a-z_0-9]*\s*[:=])")
    by_name = let(split, lambda fields: F.when(named(fields), F.array_join(F.array_sort(F.transform(fields, one)), "|")))
    return F.when(plain.rlike(r"^[a-z][a-z_0-9]*\s*[:=]"), F.coalesce(by_name, _content(plain))).otherwise(_content(plain))


def canonical_text(text: Column) -> Column:
    """One writing for all writings of a longer text: letters, digits, and signs, points and bars within numbers."""
    plain = _joined(_strip_marks(fold(text)))
    plain = F.regexp_replace(plain, r"(?<=\d)/(?=[-+]?\d)", "\u0003")
    plain = F.regexp_replace(plain, r"(?<=\d)\.(?=\d)", "\u0004")
    plain = F.regexp_replace(plain, r"(?<!\p{L})-(?=\d)", "\u0005")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\u0003-\u0005]+", "")
    return F.translate(plain, "\u0003\u0004\u0005", "/.-")


# Writings that stand for a missing answer.
PLACEHOLDERS = ["none", "null", "nan", "na", "n/a", "nil", "unknown", "tbd", "todo", "empty", "blank", "placeholder", "answer", "youranswer", "pending", "undefined", "notavailable", "notapplicable", "notgiven", "missing"]


def _nothing(plain: Column) -> Column:
    """Of a folded value without marks: nothing but blanks and punctuation, or a placeholder."""
    bare = F.regexp_replace(plain, r"[^\p{L}\p{N}/]+", "")
    return bare.isin("", "/", *PLACEHOLDERS) | bare.rlike("^no(answer|output|response|reply|result|content|text|data|value)(found|extracted|given|available|provided)?$")


def no_answer(value: Column) -> Column:
    """True for null, blank, marks only (an empty box too), and placeholders without content."""
    # texts of more letters and digits aren't folded at all; padding and rows of marks of any length don't count
    short = F.when((F.length(value) <= 80) | ~value.rlike(r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){81}"), value)
    return value.isNull() | F.coalesce(_nothing(_strip_marks(fold(short))), F.lit(False))


def answer_content(answer: Column) -> Column:
    """`canonical_answer`, but null for what is `no_answer` or has no content; the value is folded once for both."""
    return let(F.trim(_strip_marks(fold(answer))), lambda plain: F.when(~_nothing(plain), F.nullif(_canonical_plain(plain), F.lit(""))))
