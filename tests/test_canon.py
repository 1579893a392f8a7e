import pytest
from pyspark.sql import functions as F

from rolloom.functions.canon import answer_content, canonical_answer, canonical_text, no_answer

SAME = [
    ["55495", " 55,495.", "$55 495$", "55{,}495", "**55495**", "“55495”", r"\boxed{55495}", "５５４９５"],
    ["-21550", "−21,550", r"\(-21550\)", "- 21550"],
    ["x = 10, y = 655, z = 37", "z = 37,x = 10,y:655", "y: 655; z: 37; x: 10", "X=10 Y=655 Z=37"],
    ["(21, 13)", "(21 ,13)", "`(21,13)`"],
    ["no solution", "No-Solution.", "**no  solution**"],
    ["30/79", "30 /79", "$30/79$"],
    ["0.4324", " 0.4324 ", "(0.4324)"],
    ["every integer", "еvery intеger", "EVERY INTEGER"],
]


def test_one_key_for_each_class(spark):
    rows = spark.createDataFrame([(i, v) for i, vs in enumerate(SAME) for v in vs], "i int, v string").select("i", "v", canonical_answer(F.col("v")).alias("k")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.i, set()).add(r.k)
    assert all(len(k) == 1 for k in by.values()), by
    assert len(set.union(*by.values())) == len(SAME)


def test_content_is_kept_apart(spark):
    values = ["5", "-5", "0.5", "5.0", "1/5", "15", "(1, 5)", "(5, 1)", "x = 1, y = 5", "x = 5, y = 1"]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(canonical_answer(F.col("v"))).collect()]
    assert len(set(keys)) == len(values)


def test_missing(spark):
    values = [None, "", " \t", "N/A", "none", "--", r"\boxed{}", "(no output)", "0", "no solution", "x" * 200]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(no_answer(F.col("v"))).collect()]
    assert got == [True] * 8 + [False] * 3


def test_texts(spark):
    a, b, c = (
        spark.createDataFrame([(v,) for v in ("Let $x_1$ = 1,234 and 5/7.", "LET \\(X_1\\) =\t1234\nand 5 / 7", "Let x1 = 1234 and 57")], "v string").select(canonical_text(F.regexp_replace("v", " / ", "/"))).collect()
    )
    assert a[0] == b[0] != c[0]


@pytest.mark.parametrize("value,want", [(" " * 500, True), ("\n" * 90, True), ("-" * 4000, True), ("N/A" + " \t" * 300, True), ("." * 100 + "none" + "." * 100, True), ("- 5 " + "-" * 200, False), ("word and " * 20, False), ("x" * 81, False)])
def test_no_answer_of_any_length(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(no_answer(F.col("v"))).head()[0] == want


def test_content_of_answers(spark):
    values = [None, "", " \t", "N/A", "--", "0", " 1,234. ", "no solution", "x" * 200, "-" * 200, "N/A" + " " * 200, "é 5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(answer_content(F.col("v")).alias("a"), F.when(~no_answer(F.col("v")), F.nullif(canonical_answer(F.col("v")), F.lit(""))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[6].a == "1234" and got[10].a is None
