"""Cut replies and faulty pairs on a small collection in which the truth is known."""

import random

import pytest

from rolloom.llm import pairs as P
from rolloom.llm import replies as L
from rolloom.llm import truncation as C

NOUNS = "matrix vector graph kernel series integral basis group ring field module lattice tensor chain".split()
VERBS = "bounds splits meets covers divides reduces extends replaces".split()


def problem(rng):
    return "Let the " + " ".join(f"{rng.choice(NOUNS)} of level {rng.randrange(999)} and the" for _ in range(9)) + f" rest be given. What is the value of {rng.choice(NOUNS)} {rng.randrange(99)}?"


def reply(rng):
    body = " ".join(f"Then the {rng.choice(NOUNS)} {rng.choice(VERBS)} every {rng.choice(NOUNS)} of size {rng.randrange(9999)}, so that this is the {rng.choice(NOUNS)} for it." for _ in range(rng.randint(4, 9)))
    n = rng.randrange(9999)
    return body + rng.choice([f" So the result is {n}", f"\n\\boxed{{{n}}}", f"\n**ANSWER: {n}**", f"\nHence\n\\[ x = {n} \\]", f" The final answer is {n}."])


GERMAN = "Wir beginnen mit der Matrix und schreiben den Wert auf. Damit ist die Frage auf das Gitter zurückgeführt, und der Rest ist nicht mit sich selbst verträglich. Also lautet das Ergebnis {}."
GERMAN_PROBLEM = "Gegeben ist die Matrix der Stufe {} mit den Werten von {} bis {}. Wie groß ist die Summe der Gewichte, wenn man das Gitter nicht mit zählt?"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(900):
        q, t, a, kind = problem(rng), reply(rng), str(i), None
        roll = rng.random()
        if i % 15 == 0:
            q, t = GERMAN_PROBLEM.format(i, i + 3, i + 9), GERMAN.format(i) + "\n" + GERMAN.format(i + 1)
        elif roll < 0.05:
            t, kind = t[: rng.randint(120, max(121, len(t) - 60))].rstrip(" .,") + "", "truncated"
            t = t[:-1] if t[-1].isalpha() and rng.random() < 0.5 else t
        elif roll < 0.09:
            t, kind = (q if rng.random() < 0.5 else q + "\n\nAnswer:"), "copied"
        elif roll < 0.13:
            t, kind = "I'm sorry, but I am unable to provide a solution to this. Please ask a teacher.", "refusal"
        elif roll < 0.17:
            t, kind = GERMAN.format(i), "other_language"
        elif roll < 0.20:
            a, kind = rng.choice([None, "", "N/A"]), "empty"
        elif roll < 0.22:
            t, kind = rng.choice([None, "", "   "]), "empty"
        elif roll < 0.3:
            t = q + "\n\n" + t
        rows.append(("results", i, "m", q, a, t))
        truth[i] = kind
    limit = 300
    for i in range(1000, 1120):
        t = (reply(rng) + " " + reply(rng))[:limit].rstrip()
        if t[-1] in ".":
            continue
        rows.append(("results", i, "limited", problem(rng), "5", t))
        truth[i] = "truncated"
    rows += rows[:20]
    return spark.createDataFrame(rows, "tbl string, rec_id bigint, source string, problem string, answer string, text string"), truth


def test_cut_replies(made):
    df, truth = made
    got = [r.rec_id for r in C.cut_replies(df).collect()]
    want = {i for i, k in truth.items() if k == "truncated"}
    assert len(got) == len(set(got))
    assert len(want & set(got)) / len(want) > 0.93 and len(want & set(got)) / len(got) > 0.93
    share = {r.source: r.share for r in C.cut_share(df).collect()}
    assert share["limited"] > 0.9 and share["m"] < 0.15


def test_length_spike(made):
    df, _ = made
    assert ("limited", "chars", 300) in {(r.source, r.unit, r.length) for r in L.length_spikes(L.slim(L.of(df).bare)).collect()}


def test_faulty_pairs(made):
    df, truth = made
    rows = P.faulty_pairs(df, 600).collect()
    got = {r.rec_id: r.defect for r in rows}
    assert len(got) == len(rows)
    for kind in ("truncated", "copied", "refusal", "other_language", "empty"):
        want, have = {i for i, k in truth.items() if k == kind}, {i for i, k in got.items() if k == kind}
        assert len(want & have) / len(want) > 0.85 and len(want & have) / max(len(have), 1) > 0.85, kind
    assert sum(r.pairs for r in P.defect_report(df).collect()) == len(truth)


def test_nothing(spark):
    none = spark.createDataFrame([], "tbl string, rec_id bigint, source string, problem string, answer string, text string")
    assert C.cut_replies(none).collect() == [] and P.faulty_pairs(none).collect() == []
    odd = spark.createDataFrame([("results", 1, None, None, None, None), ("results", 2, None, None, "", ""), ("samples", 3, "s", "", "", "…")], none.schema)
    assert {r.rec_id for r in P.faulty_pairs(odd).collect()} >= {1, 2}


@pytest.mark.parametrize("text,marks", [("done.", (False, True, False)), ("and th…", (True, False, False)), ("$x", (False, False, True)), ("the weight is 0.", (False, False, False)), ('He said "no."', (False, True, False)), ("```\nx", (False, False, True))])
def test_ending_marks(text, marks):
    assert L.ending_marks(text) == marks


def test_reader_past_its_cap():
    small, large = L.Reader(most=10), L.Reader()
    problems = [f"word{chr(97 + i)} in a row of words" for i in range(4)]
    small.read_again(problems[:2]), small.read([f"text{chr(97 + i)}" for i in range(20)])
    for a, b in zip(small.read_again([*problems, None]), large.read_again([*problems, None])):
        assert [x.tolist() for x in a] == [x.tolist() for x in b]


TAILS = [
    "Then the kernel covers all of " + " and then ".join("the matrix and x" for _ in range(40)) + t
    for t in (" is (" + ", ".join(map(str, range(1, 151))) + ")", " is (" + ", ".join(map(str, range(1, 151))), " a = 3, b = -4, c = 5", " a = 3, b = -4, c =", "", " …", " x" * 300, "(1, 2) (3, 4)", " " + "9" * 400, " " + "-" * 500, " ΑΣ ΣΑΣ")
]


@pytest.mark.parametrize("text", [*TAILS, "a", "a b", "7, 8"])
def test_last_tokens_are_those_of_the_whole_text(text):
    one, other = L.Reader(), L.Reader()
    (a, at_a), (b, at_b) = one.read([text], lambda t: one.last(t)[-3:]), other.read([text])
    assert a.tolist() == b[-3:].tolist()


@pytest.mark.parametrize("text", [*TAILS, "x = 3, y=4; (1, 2), (1,2) a_b c_1 1,000.5 ½ don't\u00a0stop\u2003x\x1cy"])
def test_pieces_are_read_as_the_whole_text(text):
    reader = L.Reader()
    tokens = L.TOKEN.findall(text.lower())
    assert reader.read([text])[0].tolist() == [L.xxhash.xxh64_intdigest("#" if L._is_number(t) else t) for t in tokens]


def test_copies_of_a_cut_reply_dont_certify_its_end(spark):
    rng = random.Random(2)
    rows = [("results", i, "m", problem(rng), "5", reply(rng)) for i in range(300)]
    cut = "Then the matrix covers every lattice of size 71, so that this is the kernel for it. We turn to the remaining module whose outer"
    rows += [("results", 1000 + i, "m", problem(rng), "5", cut + " " * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, source string, problem string, answer string, text string")
    assert {r.rec_id for r in C.cut_replies(df).collect()} >= set(range(1000, 1040))
    once, twice = L.of(df).bare, L.of(df.union(df)).bare
    assert L.known_endings(once, L.slim(once)) == L.known_endings(twice, L.slim(twice))


@pytest.mark.parametrize("text,left", [("It costs $5.", False), ("Pay \\$5 for $x$ and $y.", True), ("Hence $x = 3.", True), (r"\left\{ \begin{array}{l} 1 \end{array} \right. done.", False), (r"the set \{1, 2.", True), ("$5 + x$ holds.", False)])
def test_left_open(text, left):
    assert L.ending_marks(text)[2] == left


def test_cut_in_an_open_block_behind_a_stop(spark):
    rng = random.Random(8)
    rows = [("results", i, "m", problem(rng), "5", reply(rng)) for i in range(500)]
    opened = [" Now we have \\[ a = 3.", " Hence the value $x = 3.", "\n```\nprint(x) # done.", " So take \\boxed{the kernel."]
    rows += [("results", 1000 + i, "m", problem(rng), "5", reply(rng) + opened[i % 4]) for i in range(12)]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, source string, problem string, answer string, text string")
    assert {r.rec_id for r in C.cut_replies(df).collect()} == set(range(1000, 1012))
    assert {r.rec_id for r in P.faulty_pairs(df, 400).where("defect = 'truncated'").collect()} == set(range(1000, 1012))


def test_long_blanks_and_short_problems(spark):
    rng = random.Random(3)
    rows = [("results", i, "m", problem(rng), str(i), reply(rng)) for i in range(400)]
    rows += [("results", 1000, "m", problem(rng), "5", "-" * 300), ("results", 1001, "m", problem(rng), "5", "N/A" + " " * 200), ("results", 1002, "m", problem(rng), " " * 100, reply(rng)), ("results", 1003, "m", problem(rng), "5", "N/A " + "-" * 100)]
    rows += [("results", 2000 + i, "m", f"What is the rank of {w}?", f"What is the rank of {w}?", reply(rng)) for i, w in enumerate(NOUNS)]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, source string, problem string, answer string, text string")
    assert not {r.rec_id for r in C.cut_replies(df).collect()} & set(range(1000, 1004))
    got = {r.rec_id: r.defect for r in P.faulty_pairs(df, 400).collect()}
    assert {i: got.get(i) for i in range(1000, 1004)} == dict.fromkeys(range(1000, 1004), "empty")
    assert {got.get(2000 + i) for i in range(len(NOUNS))} == {"copied"}
