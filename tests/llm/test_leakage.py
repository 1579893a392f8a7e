import random

from rolloom.functions.words import words
from rolloom.llm import leakage as L

END = " Show your work and state the final answer on the last line."


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}x" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 30]))) + "." + END) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(150):
        body = words(items[rng.randrange(12)][1])
        a = rng.randrange(len(body))
        part = body[a : a + rng.randint(5, 20)]
        docs.append((d, " ".join(rng.choice(vocabulary) for _ in range(5)) + "\n" + (",  ".join(part)).upper() + " end"))
    docs += [(900, None), (901, ""), (902, END * 3), (903, "​".join(items[2][1]))]
    known = L.texts_of(spark.createDataFrame(items, "item_id bigint, prompt string"))[1]
    assert known == ["show your work and state the final answer on the last line"]
    own = {i: words(p.replace(END, "")) for i, p in items if p}
    want = set()
    for d, t in docs:
        w = words(t)
        for i, s in own.items():
            runs = {tuple(s[k : k + 12]) for k in range(len(s) - 11)}
            if any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11)):
                want.add((d, i))
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id")
    eval_items = spark.createDataFrame(items, "item_id bigint, prompt string")
    assert {tuple(r) for r in L.leaks(documents, eval_items).collect()} == want
    assert L.leaks(documents.where("false"), eval_items).collect() == [] and L.leaks(documents, eval_items.where("false")).collect() == []
    report = {r.item_id: (r.of_statement if r.longest >= 12 else 0) for r in L.leak_report(documents, eval_items).collect()}
    assert {i: n for i, n in report.items() if i not in own or len(own[i]) >= 12} == {i: len({d for d, j in want if j == i}) for i, _ in items if i not in own or len(own[i]) >= 12}


def test_places_in_the_original(spark):
    statement = " ".join(f"word{i}" for i in range(14))
    text = "Ｘ ﬁrst: café " + statement.replace("word3", "ＷＯＲＤ３").replace(" ", " ​") + " after"
    found = L.passages(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(7, statement)], "item_id bigint, prompt string")).head()
    assert (found.item_id, found.n_words) == (7, 14)
    assert words(text[found.start : found.end]) == words(statement)


def test_passages_are_as_long_as_the_words_agree(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5)]
    machine = L.Automaton([(i, "statement", [rng.choice(vocabulary) for _ in range(rng.choice([7, 12, 19, 31]))]) for i in range(30)])
    for _ in range(300):
        w = [rng.choice([*vocabulary, "z"]) for _ in range(rng.randrange(40))]
        item = rng.choice(machine.texts)
        names = {n: x for x, n in machine.number.items()}
        at, a = rng.randrange(len(w) + 1), rng.randrange(len(item[2]))
        w[at:at] = [names[n] for n in item[2][a : a + rng.randrange(25)]]
        want = set()
        for t, _, ids in machine.texts:
            text, run = [names[n] for n in ids], min(12, len(ids))
            places = sorted({k for k in range(len(w) - run + 1) for j in range(len(text) - run + 1) if w[k : k + run] == text[j : j + run]})
            spans = []
            for k in places:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + run
                else:
                    spans.append([k, k + run])
            want |= {(t, x, y) for x, y in spans}
        assert {(t, x, y) for t, _, x, y in machine.passages(w)} == want


def test_references_and_short_statements(spark):
    items = spark.createDataFrame([(1, "Find all lost keys of Ann Brown now.", "First we " + " ".join(f"step{i}" for i in range(14))), (2, "Too short.", "866")], "item_id bigint, prompt string, reference string")
    docs = spark.createDataFrame([(1, "He said: find all lost keys of Ann Brown now!"), (2, " ".join(f"step{i}" for i in range(14))), (3, "Too short. 866")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.part, r.n_words) for r in L.passages(docs, items).collect()} == {(1, 1, "statement", 8), (2, 1, "reference", 14)}
    assert L.leaks(docs, items).collect() == []
    assert {tuple(r) for r in L.leak_report(docs, items).collect()} == {(1, 2, 14, 1, 1), (2, 0, 0, 0, 0)}


def test_many_items_in_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(13))) for i in range(9)], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(13))) for i in range(9)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.passages(docs, items, most=4).collect()} == {(i, i) for i in range(9)}


def test_only_instructions_at_the_end_of_different_prompts_are_left_out(spark):
    opening = "Let n be a positive integer whose digits are all odd."
    bodies = [" ".join(f"b{i}w{k}" for k in range(8)) + "." for i in range(4)]
    edited = [f"{w} squares of side nine are cut from a sheet of grey paper. How many corners does the rest of that sheet of paper have?" for w in ("Seven", "Eight", "Some")]
    items = [(i, f"{opening} {b}{END}") for i, b in enumerate(bodies)] + [(10 + i, t) for i, t in enumerate(edited)] + [(20, f"{bodies[0]} {opening} What is it?")]
    rows, known = L.texts_of(spark.createDataFrame(items, "item_id bigint, prompt string"))
    assert known == [" ".join(words(END))]
    assert {i: w for i, _, w in rows} == {i: words(t.replace(END, "")) for i, t in items}
    docs = spark.createDataFrame([(1, f"{opening} {bodies[2]}"), (2, edited[0]), (3, END), (4, f"{bodies[1]} {bodies[2]}")], "doc_id bigint, text string")
    assert {tuple(r) for r in L.leaks(docs, spark.createDataFrame(items, "item_id bigint, prompt string")).collect()} == {(1, 2), (2, 10), (2, 11), (2, 12)}


def test_instructions_are_learned_over_all_blocks(spark):
    end = " Show your work in full and state the final answer on the very last line of your reply."
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(13)) + "." + end) for i in range(9)], "item_id bigint, prompt string")
    docs = spark.createDataFrame([(1, end), (2, " ".join(f"i4w{k}" for k in range(13)))], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.passages(docs, items, most=2).collect()} == {(2, 4)} == {tuple(r) for r in L.leaks(docs, items).collect()}
