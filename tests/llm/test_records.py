"""Overlaps, near-duplicates and copies against brute force, with nulls, empty and long texts, ties, hot groups and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolloom.functions.words import words
from rolloom.llm import crosssplit, ledger, nearpivot

LONG = "Problem number {} : " + " ".join(f"term{i}" for i in range(60)) + " What is the value of {} ?"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def near_rows():
    rng = random.Random(3)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(400)}w" for _ in range(rng.randint(8, 60))] for _ in range(25)]
    rows, i = [(None, "x")][:0], 0
    for b in base:
        for _ in range(6):
            w = [x for x in b if rng.random() > 0.12] + [f"n{rng.randrange(9999)}" for _ in range(rng.randint(0, 5))]
            rng.shuffle(w)
            i += 1
            rows.append((i, " ".join(w).upper() if i % 4 == 0 else ", ".join(w)))
    rows += [(900, None), (901, ""), (902, " ?! "), (903, "In 5 steps find 7 of it"), (904, "In 66 steps find 123 of it"), (905, LONG.format(1, 2)), (906, LONG.format(1, 2))]
    rows += [(1000 + k, "a hot copy of one text, again and again") for k in range(80)]
    return rows


def test_near_groups_against_brute_force(spark):
    rows = near_rows()
    bags = {i: Counter(words(t)) for i, t in rows if words(t)}
    masks = {i: frozenset(Counter(w for w in words(t) if not any(c.isdigit() for c in w)).items()) for i, t in rows if words(t)}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            union = sum(bags[a].values()) + sum(bags[b].values()) - both
            if both * 10 >= 7 * union or masks[a] and masks[a] == masks[b]:
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(rows, "rec_id bigint, text string")
    got = {r.rec_id: r.group_id for r in nearpivot.near_groups(df).collect()}
    assert got == {i: find(i) for i in ids}
    groups = spark.createDataFrame(list(got.items()), "rec_id bigint, group_id bigint")
    wanted = {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}
    assert pairs(nearpivot.pairs_of_groups(groups)) == wanted


def test_pivots_discard_by_the_largest_difference(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        n = [rng.randrange(1, 200) for _ in "ab"]
        far = [[rng.randrange(513) for _ in range(nearpivot.PIVOTS)] for _ in "a"] * 2
        far[1] = [min(512, max(0, x + rng.randint(-40, 40) if rng.random() < 0.2 else x)) for x in far[0]]
        pack = lambda f: [sum(v << nearpivot.BITS * k for k, v in enumerate(f[i : i + nearpivot.LANES])) for i in range(0, nearpivot.PIVOTS, nearpivot.LANES)]
        rows.append((*n, *pack(far[0]), *pack(far[1]), max(abs(x - y) for x, y in zip(*far)), abs(n[0] - n[1]), (n[0] + n[1]) * 3 // 17))
    names = ["na", "nb", *(c + s for s in "ab" for c in nearpivot.PACKED), "largest", "longer", "most"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('na', 'nb') else 'bigint'}" for c in names))
    for c in nearpivot.PRINT:
        df = df.selectExpr("*", f"7L as {c}a", f"7L as {c}b")
    got = df.select((nearpivot.may_be_close() == F.expr("largest <= most and longer <= most")).alias("ok"), nearpivot.may_be_close().alias("close")).collect()
    assert all(r.ok for r in got) and 0 < sum(r.close for r in got) < 300


def test_near_groups_of_nothing(spark):
    assert nearpivot.near_groups(spark.createDataFrame([], "rec_id bigint, text string")).collect() == []
    assert nearpivot.near_groups(spark.createDataFrame([(1, None), (2, "")], "rec_id bigint, text string")).collect() == []


PROBLEM = "Let $x$ be a {} number of type Foo with 23 trials. It is known that 0.586 of all schemes are ergodic. Find the value of y at level {}."


def test_overlaps(spark):
    body = PROBLEM.format("stationary", 44)
    rows = [
        (1, body, "866", "train"), (2, body.upper().replace(" ", "  "), "$866$", "Test "), (3, body.replace("stationary", "statoinary") + " Round your answer to 4 decimal places.", None, "val"),
        (4, PROBLEM.format("stationary", 45), "866", "test"), (5, body, "867", "test"), (6, body, "866", None), (7, body, "866", "train"), (8, None, "1", "test"), (9, "", "1", "train"), (10, "short words only here", "", "train"), (11, "Short, words only HERE!", "", "test"),
        (12, body, "work #### 866", "TRAIN"), (12, body, "work #### 866", "TRAIN"),
    ]
    rows += [(100 + i, f"Another {w} task about {w}{w} with {i * 7 + 11} and {i * 3 + 500} and {i + 9000}. Round your answer to 4 decimal places.", str(i), "train") for i, w in enumerate("abcdefghijklmnopqrst")]
    df = spark.createDataFrame(rows, "problem_id bigint, prompt string, reference string, split string").selectExpr("*", "'s' as source", "1 as rec_id")
    wanted = {(a, b) for a in (1, 7, 12) for b in (2, 3)} | {(10, 11)}
    got = pairs(crosssplit.overlap_pairs(df))
    assert {tuple(sorted(p)) for p in wanted} == got
    report = {r.split: (r.problems, r.leaked, r.pairs) for r in crosssplit.overlap_report(df).collect()}
    assert report == {"test": (5, 2, 4), "val": (1, 1, 3)}
    assert crosssplit.overlap_pairs(df.where("false")).collect() == []


def test_overlaps_of_a_hot_group(spark):
    hot = "A chain with {} links hangs from hook {}, and {} of its rings are painted {}. Every ring of the chain weighs {} grams. How many grams does the painted part of that chain weigh?"
    colours = "red green blue white black grey brown pink gold teal".split()
    rows = [(i, hot.format(12, 34, 56, c, 78), "9", "train" if i < 5 else "test") for i, c in enumerate(colours)]
    rows += [(20 + i, hot.format(12, 34, 56, c, 79), None, "test") for i, c in enumerate(colours)]  # the sentence with the weight differs in its number only
    rows += [(40, hot.format(12, 34, 56, "red", 78).replace("Every ring of the chain weighs", "Rings on the chain do all weigh"), "9", "test")]  # one sentence written anew
    rows += [(100 + i, f"Tower {w}{w} holds {w}a stones {i * 7 + 11} and {w}b stones {i * 3 + 500} above {i + 9000}. Which one falls?", str(i), "train") for i, w in enumerate("abcdefghijklmnopqrst")]
    df = spark.createDataFrame(rows, "problem_id bigint, prompt string, reference string, split string").selectExpr("*", "'s' as source")
    assert pairs(crosssplit.overlap_pairs(df)) == {(a, b) for a in range(5) for b in [*range(5, 10), 40]}


def test_overlaps_in_other_number_writings(spark):
    text = "A road of 1000 metres has {} posts of 10 cm each, and x_1 + x_2 = 2500000 with x^2 below 7. How many posts does the road have in all its parts?"
    other = text.replace("1000", "1,000").replace("10 cm", "10cm").replace("x_1", "x1").replace("x_2", "x₂").replace("2500000", "2 500 000").replace("x^2", "x²")
    rows = [(1, text.format(77), "train"), (2, other.format(77), "test"), (3, other.format(78), "test"), (4, text.format("(100,200)"), "train"), (5, other.format("(100, 200)"), "test"), (6, other.format("100 200"), "test")]
    df = spark.createDataFrame(rows, "problem_id bigint, prompt string, split string").selectExpr("*", "'5' as reference", "'s' as source")
    assert pairs(crosssplit.overlap_pairs(df)) == {(1, 2), (4, 5)}


def test_overlaps_of_many_problems_with_the_same_few_quantities(spark):
    rng = random.Random(5)
    nouns = [f"{a}{b}" for a in "ba ke li mo nu pa ri so tu ve".split() for b in "rk st nd lm sp".split()]
    task = lambda: " ".join(rng.choice(nouns) for _ in range(25)) + " 1 " + " ".join(rng.choice(nouns) for _ in range(20)) + " 2 and 3?"
    texts = [task() for _ in range(120)]
    rows = [(i, t, "train") for i, t in enumerate(texts)] + [(200 + i, t.replace(" 1 ", " 1 then "), "test") for i, t in enumerate(texts[:60])]
    df = spark.createDataFrame(rows, "problem_id bigint, prompt string, split string").selectExpr("*", "null as reference", "null as source")
    assert pairs(crosssplit.overlap_pairs(df)) == {(i, 200 + i) for i in range(60)}
    assert [tuple(r) for r in crosssplit.overlap_report(df).collect()] == [("test", "(none)", 60, 60, 60)]


def test_an_instruction_of_seventy_words(spark):
    long = " ".join(f"Instruction{i} must" for i in range(35)) + "."
    known = crosssplit.Statement([" ".join(words(long))])
    assert known("Find the rank of it. " + long) == words("Find the rank of it.")


@pytest.mark.parametrize("text,want", [("1,000", "1000"), ("1 234 567 of", "1234567 of"), ("1{,}000; 1'000", "1000; 1000"), ("12,34", "12,34"), ("0.586,100", "0.586,100"), ("10cm x² ٣", "10 cm x 2 3"), ("[1,234]", "[1,234]"), ("1,0000", "1,0000")])
def test_canonical_numbers(text, want):
    assert crosssplit.canonical_numbers(text) == want


def wanted_of(rows):
    wanted = {}
    for i, k in {r for r in rows if r[1]}:
        n, first = wanted.get(k, (0, i))
        wanted[k] = (n + 1, min(first, i))
    return wanted


def state(book):
    return {bytes(r.key).decode(): (r.n, r.first_id) for r in book.counts().collect()}


def keyed_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcdefgh") if rng.random() < 0.6 else "hot") for i in range(500)] + [(600, None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "rec_id bigint, key string").selectExpr("rec_id", "cast(key as binary) as key")


def test_ledger_of_two_sessions_is_the_same_as_one_batch(spark, tmp_path):
    rows, df = keyed_rows(spark)
    once = ledger.Ledger(spark, f"{tmp_path}/once")
    once.add(df, "key", "rec_id", "all")
    first = ledger.Ledger(spark, f"{tmp_path}/ledger")
    assert first.add(df.where("rec_id % 2 = 0"), "key", "rec_id", "even")
    (tmp_path / "ledger" / "counts-broken-off").mkdir()
    again = ledger.Ledger(spark, f"{tmp_path}/ledger")  # another session's view, after a run that broke off
    assert not again.add(df.where("rec_id % 2 = 0"), "key", "rec_id", "even")
    assert again.add(df.where("rec_id % 2 = 1 or rec_id < 100"), "key", "rec_id", "odd, and some delivered again")
    assert again.add(df.where("false"), "key", "rec_id", "nothing")
    for book in (once, again, ledger.Ledger(spark, f"{tmp_path}/ledger")):
        assert state(book) == wanted_of(rows)
        assert book.members().count() == 500
    held = {name for name, _ in again.state["counts"] + again.state["members"]}
    assert {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")} == held | {"manifest-000000003.json"}
    wanted = wanted_of(rows)
    assert pairs(ledger.copies(again)) == {(wanted[k][1], i) for i, k in rows if k and i != wanted[k][1]}
    with pytest.raises(Exception):
        first.add(df.where("rec_id = 3"), "key", "rec_id", "a writer that comes too late")


def test_ledger_grows_more_buckets(spark, tmp_path):
    rows, df = keyed_rows(spark)
    book = ledger.Ledger(spark, f"{tmp_path}/ledger", per_bucket=3)
    for part in range(3):
        book.add(df.where(f"rec_id % 3 = {part}"), "key", "rec_id", str(part))
    assert book.state["buckets"] == 4 and state(book) == wanted_of(rows)
    before = {name for name, _ in book.state["counts"]}
    book.add(spark.createDataFrame([(b"a", 5000)], "key binary, rec_id bigint"), "key", "rec_id", "one record")
    assert before & {name for name, _ in book.state["counts"]}  # the other buckets were taken over
    assert state(book)["a"][0] == wanted_of(rows)["a"][0] + 1


def test_answer_copies(spark):
    rows = [(3, 1, "1,234"), (1, 1, "$1234$"), (2, 1, "1234."), (4, 2, "1234"), (5, 1, None), (6, 1, " "), (7, 1, "N/A"), (8, 1, "N/A"), (2, 1, "1234."), (9, None, "5"), (10, None, "5")]
    df = spark.createDataFrame(rows, "result_id bigint, run_id bigint, answer string").selectExpr("*", "timestamp'2025-01-01' + make_interval(0,0,0,cast(result_id as int)) as received_at", "1 as key")
    book = ledger.build(df, "received_at", ledger.answer_records)
    assert pairs(ledger.copies(book)) == {(1, 2), (1, 3), (9, 10)}
    assert {r.copies for r in ledger.collapsed(book).collect()} == {1, 2, 3}
    assert ledger.copies(ledger.build(df.where("false"), "received_at", ledger.answer_records)).collect() == []


def test_problem_copies(spark):
    rows = [(1, "Find X.", ["1", "2", ""]), (2, "find  x", ["2", "$1$", None]), (3, "Find X.", ["1", "2"]), (4, "Find X.", ["1", "1", "2"]), (5, None, None), (6, None, None), (7, "Find X.", []), (8, "Find X.", None)]
    df = spark.createDataFrame(rows, "gen_id bigint, problem string, all_answers array<string>").selectExpr("*", "timestamp'2025-01-01' as ingested_at")
    assert pairs(ledger.copies(ledger.build(df, "ingested_at", ledger.problem_records))) == {(1, 2), (5, 6)}


@pytest.mark.parametrize("text,count", [("", 0), (None, 0), ("½ Ａb_c", 4)])
def test_words(text, count):
    assert len(words(text)) == count
