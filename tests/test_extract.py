"""Table-driven tests of extraction, normal writings and rewards."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolloom.functions import extract as X
from rolloom.functions import helpers as H
from rolloom.functions import rewards as R


def apply(spark, build, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.withColumn("o", build(F.col("t"))).orderBy("i").select("o").collect()]


CASES = [
    (X.boxed, r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"),
    (X.boxed, r"\boxed{1} \boxed{2", None),
    (X.boxed, r"\boxed{}", ""),
    (X.boxed, "none", None),
    (X.boxed, None, None),
    (X.boxed, "\\boxed{ \U0001f600 é }", "\U0001f600 é"),
    (X.boxed_or_empty, "none", ""),
    (X.flat_boxed, r"\boxed{\frac{1}{2}}", r"\frac{1"),
    (X.answer_tag, "**ANSWER: 1** … **answer: 2**", "2"),
    (X.answer_tag, "no", None),
    (X.final_phrase, "The answer is 3.14", "3"),
    (X.chain_tag_first, "**ANSWER:   ** so \\boxed{2}", ""),
    (X.chain_box_first, "\\boxed{} **ANSWER: 4**", "4"),
    (X.chain_box_first, "no idea", ""),
    (X.chain_cleaned, r"\boxed{x = 5}", "5"),
    (X.chain_cleaned_checked, r"\boxed{<answer>}", ""),
    (X.chain_display, "nothing", "(no answer extracted)"),
    (X.problem_block, "x\n=== PROBLEM START ===\n\n find x \n=== PROBLEM END ===\n", "find x"),
    (X.normal_number, "3,264.0000", "3264"),
    (X.normal_number, "7.50", "7.5"),
    (X.normal_number, "1..", "1"),
    (X.normal_number, "nan", "nan"),
    (X.normal_number, "-0.0", "0"),
    (X.normal_number, "1e5", "100000"),
    (X.normal_number, "12345678901234567890", "12345678901234567168"),
    (X.normal_number, "abc", "abc"),
    (X.normal_number, "", ""),
    (X.clean_boxed, "x = 5", "5"),
    (X.clean_boxed, r"\lfloor 8.0 \rfloor", "8"),
    (X.gate_answer, "1/2", "0.5"),
    (X.gate_answer, "0,5", "0.5"),
    (X.gate_answer, r"$\{3\}$", "3"),
    (X.gate_answer, "326400000000", "3.264e+11"),
    (X.gate_answer, "1e5", "1e5"),
    (X.gate_answer, "+5", "+5"),
    (X.clean_boxed, r"\text{about} \bigl 7,000.\;", "7000"),
    (X.is_numeric, "0.6079", True),
    (X.is_numeric, "-3", True),
    (X.is_numeric, "3/2", True),
    (X.is_numeric, "1e5", False),
    (X.reject_placeholder, "<answer>", ""),
    (X.strip_latex, r" \text{CC}\,O ", "CCO"),
]


def test_cases(spark):
    for build in {c[0] for c in CASES}:
        mine = [c for c in CASES if c[0] is build]
        assert apply(spark, build, *[c[1] for c in mine]) == [c[2] for c in mine], build.__name__


def test_boxed_against_a_plain_statement(spark):
    def plain(t):
        at = t.rfind("\\boxed{")
        if at < 0:
            return None
        depth, out = 1, ""
        for c in t[at + 7 :]:
            depth += (c == "{") - (c == "}")
            if not depth:
                return out.strip()
            out += c
        return None

    texts = []

    @settings(max_examples=300, database=None)
    @given(st.lists(st.sampled_from(["\\boxed{", "{", "}", "a", " ", "1"]), max_size=12))
    def make(parts):
        texts.append("".join(parts))

    make()
    assert apply(spark, X.boxed, *texts) == [plain(t) for t in texts]


def test_normal_number_against_python(spark):
    def plain(t):
        t = t.replace(",", "").replace(" ", "").strip().rstrip(".")
        try:
            v = float(t)
            return str(int(v)) if v == int(v) else str(v)
        except (ValueError, OverflowError):
            return t

    texts = []

    @settings(max_examples=300, database=None)
    @given(st.from_regex(r"[+-]?[0-9]{0,6}[.,]?[0-9]{0,7}(e[0-9])?", fullmatch=True))
    def make(t):
        texts.append(t)

    make()
    assert apply(spark, X.normal_number, *texts) == [plain(t) for t in texts]


REWARDS = [
    (R.exact_match, "it is 1234", "23", 1.0), (R.exact_match, "x", "", 0.0), (R.boxed_match, r"\boxed{5}", "work #### 5", 1.0), (R.boxed_match, "5", "5", 0.0), (R.boxed_match, r"\boxed{}", "", 1.0),
    (R.boxed_format_bonus, "no", "", -0.1), (R.contains_reference, "So ABC", "abc", 1.0), (R.contains_reference, "x", "", 0.0), (R.answer_tag_match, "**Answer: 5.0**", "5", 1.0), (R.answer_tag_format_bonus, "**ANSWER: x**", "", 0.1),
    (R.regex_match("a.b"), "a\nb", "", 1.0), (R.length_penalty(), "w " * 515, "", -0.003), (R.length_penalty(), None, None, 0.0), (R.smiles_match, r"\boxed{\text{CCO}}", "CCO", 1.0), (R.smiles_match, "CCO", "CCO", 0.0),
    (R.combined((1.0, R.boxed_match), (0.5, R.boxed_format_bonus)), r"\boxed{5}", "5", 1.05), (R.boxed_match, None, None, 0.0),
]


@pytest.mark.parametrize("case", REWARDS, ids=lambda c: c[0].name)
def test_rewards(spark, case):
    reward, response, reference, wanted = case
    row = spark.createDataFrame([(response, reference)], "t string, r string").select(reward(F.col("t"), F.col("r"))).head()
    assert row[0] == pytest.approx(wanted)


def test_combined_has_a_name():
    assert R.combined((1.0, R.boxed_match), (0.5, R.exact_match)).name == "1.0*boxed_match + 0.5*exact_match"


def test_helpers(spark):
    row = spark.createDataFrame([("p", [1, 2, 3], [7, 8], [0.1, 0.2])], "p string, a array<int>, b array<int>, l array<double>").select(
        H.fill("{{x}} {p}{q}", p=F.col("p"), q=F.lit(None)).alias("fill"), H.chat_text(H.messages(F.col("p"), "!", "s")).alias("chat"), H.padded(F.col("a"), F.col("b"), F.col("l"), F.lit(0.5)).alias("pad"), F.size(H.zipped(F.col("a"), F.col("b"))).alias("zip"),
        H.provider_of(F.lit("open_ai_3")).alias("provider"), H.percent(F.lit(0.125)).alias("percent"), H.with_hidden(F.lit("h"), F.col("p")).alias("hidden"),
        H.merged(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))).alias("merged"),
    ).head()
    assert row.fill == "{x} p" and row.zip == 2 and row.provider == "open_ai" and row.hidden == "h\n\np" and row.merged == {"a": 2}
    assert row.chat == "<|start|>system<|message|>s<|end|><|start|>user<|message|>p!<|end|><|start|>assistant"
    assert row.pad.input == [1, 2, 3, 7] and row.pad.target_tokens == [0, 0, 7, 8] and row.pad.advantages == [0, 0, 0.5, 0.5]
    assert re.fullmatch(r"12\.[45]%", row.percent) or row.percent == "12.5%"
