import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import rolloom
from rolloom.__main__ import main
from rolloom.functions import helpers as H
from rolloom.operators import consistency as C
from rolloom.operators import documents as D
from rolloom.operators import evaluate as E
from rolloom.operators import grpo as G
from rolloom.sources import loaders, providers, sinks
from rolloom.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_votes(spark):
    s = spark.createDataFrame([(1, i, a) for i, a in enumerate("baab")] + [(2, i, a) for i, a in enumerate(["", "", "5", "5", "5"])] + [(3, 0, "")], "p int, i int, a string")
    assert {r.p: r.majority for r in C.majority(s, ["p"], "a", "i").collect()} == {1: "b", 2: "5", 3: ""}
    assert {r.p: r.agreement_rate for r in C.agreement_all(s, ["p"], "a", "i").collect()} == {1: 0.5, 2: 0.6, 3: 1.0}
    assert rows(C.agreement_valid(s, ["p"], "a", "i"), "p") == [(1, "b", 0.5, 4, 0), (2, "5", 1.0, 3, 2), (3, "", 0.0, 0, 1)]
    assert C.distribution(s.where("p = 1"), ["p"], "a", "i").head().distribution == [("b", 2), ("a", 2)]


def test_batches(spark):
    p = spark.range(50).withColumnRenamed("id", "problem_id")
    full = G.batches(p, "problem_id", 16)
    assert full.count() == 48 and full.agg(F.max("batch_idx")).head()[0] == 2
    assert G.batches(p, "problem_id", 16, keep_tail=True).count() == 50
    assert G.batches(p.where("false"), "problem_id", 16).count() == 0
    assert G.epoch_steps(full, 2).agg(F.max("step"), F.max("done_frac")).head() == (5, 1.0)
    assert len(G.schedule(50, 16, 2)) == 6
    with pytest.raises(ValueError):
        G.schedule(21, 25, 1)


def test_training_step(spark):
    r = spark.createDataFrame([(0, 1, 0, 1.0), (0, 1, 1, 0.0), (0, 2, 0, 0.1), (0, 2, 1, 0.1), (0, 3, 0, None)], "step int, problem_id int, sample_idx int, reward double")
    assert {x.advantage for x in G.advantages(r).where("problem_id = 1").collect()} == {0.5, -0.5}
    assert G.with_signal(r).count() == 2
    m = G.step_metrics(r, F.lit(3)).head()
    assert m.reward_mean == pytest.approx(0.3) and m.skipped_frac == pytest.approx(2 / 3) and m.datums == 2 and m.advantage_std == pytest.approx((0.5 / 4) ** 0.5)
    d = G.datums(r.selectExpr("*", "array(1, 2) as prompt_tokens", "array(5) as tokens", "array(0.5D) as logprobs"))
    assert {tuple(x.target_tokens) for x in d.collect()} == {(0, 5)}


def test_gate_and_target(spark):
    c = spark.createDataFrame([(1, 0.6, "5"), (2, 0.8, "x"), (3, 0.7, ""), (4, 0.9, "5"), (5, 0.8, "7"), (6, 0.7, "1")], "n int, rate double, a string")
    out = c.select("n", C.gate_status(F.col("rate"), F.col("a"), F.col("a")).alias("s"), C.keep_gate(F.col("rate"), F.col("a"), F.col("a")).alias("k"))
    assert [r.s for r in out.orderBy("n").collect()] == ["KEEP", "skip (non-numeric: x)", "skip (empty answer)", "skip", "KEEP", "KEEP"]
    assert C.until_target(out, "k", "n", 2).count() == 5
    assert C.until_target(out, "k", "n", 9).count() == 6
    assert C.until_target(out, "k", "n", 0).count() == 0


def test_first_wins_and_totals(spark):
    k = spark.createDataFrame([("b/keeps.json", 0, " p "), ("a/keeps.json", 1, "p"), ("a/keeps.json", 2, ""), ("a/keeps.json", 3, None)], "path string, pos int, problem string")
    assert rows(C.first_wins(k, "problem", ["path", "pos"]), "path") == [("a/keeps.json", 1, "p")]
    t = C.run_totals(spark.createDataFrame([("a", 2), ("b", None)], "run string, n int"), "run", "n")
    assert {(r.run, r.n_problems) for r in t.collect()} == {("a", 2), ("b", 0), (None, 2)}
    assert C.random_picks(spark.range(5), "id", 30, 1).count() == 30


def test_evaluation(spark):
    s = spark.createDataFrame([(1, "c", "x", 0), (1, "o", "y", 1), (1, "g", "y", 2), (2, "c", "x", 3), (2, "o", "y", 4), (3, "g", "", 5)], "q int, m string, a string, i int")
    assert {(r.q, r.majority_vote) for r in E.two_level_vote(s, "q", "m", "a", "i", ["c", "o", "g"]).collect()} == {(1, "y"), (2, "x")}
    v = E.model_agreement(spark.createDataFrame([(1, "c", None), (1, "o", "1"), (1, "g", None), (2, "c", "1"), (2, "o", "1"), (3, "c", "1"), (3, "o", "2")], "q int, m string, a string"), "q", "m", "a")
    assert {r.q: r.verdict for r in v.collect()} == {1: None, 2: "agree", 3: "disagree"}
    rates = E.any_all_rates(spark.createDataFrame([(2, 2), (1, 2), (0, 2)], "n_correct int, n_samples int")).head()
    assert rates.any_rate == pytest.approx(2 / 3) and rates.all_rate == pytest.approx(1 / 3) and rates.sample_rate == 0.5
    listing = spark.createDataFrame([("training", "x/ckpt-000050", 2), ("training", "x/ckpt-000051", 3), ("sampler", "x/ckpt-000050", 4)], "checkpoint_type string, path string, time int")
    assert E.checkpoints(listing, 50).head().time == 2


def test_sources(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"prompt": "p1", "reference": null, "k": 1}\n\n {"prompt": "", "reference": "x"}\n{"prompt": "p2", "reference": true}\n{"prompt": "p3"}\n')
    got = rows(loaders.load_problems(spark, str(f)), "problem_id")
    assert [(r[1], r[2]) for r in got] == [("p1", "None"), ("p2", "True"), ("p3", "")] and got[0][3] == {"k": "1"}
    assert loaders.load_problems(spark, str(f), limit=2).count() == 2 and loaders.load_problems(spark, str(f), limit=0).count() == 3
    g = tmp_path / "b.json"
    g.write_text('[{"prompt": "p", "reference": 5}]')
    assert loaders.load_problems(spark, str(g)).head().reference == "5"
    g.write_text('{"prompt": "p"}')
    with pytest.raises(ValueError):
        loaders.load_problems(spark, str(g))
    c = tmp_path / "c.csv"
    c.write_text('prompt,reference\n"a ""q"",\nb",1\nshort\nempty,\nquoted,""\n')
    assert [(r.prompt, r.reference) for r in loaders.load_problems(spark, str(c)).orderBy("problem_id").collect()] == [('a "q",\nb', "1"), ("short", "None"), ("empty", ""), ("quoted", "")]
    table = spark.createDataFrame([("p", None, None), ("q", True, "x"), (None, False, "y")], "prompt string, reference boolean, k string")
    assert [(r.prompt, r.reference, r.meta) for r in loaders.load_problems(spark, table).orderBy("problem_id").collect()] == [("p", "None", {"k": None}), ("q", "True", {"k": "x"})]
    twice = spark.createDataFrame([(1, "b"), (2, "c"), (1, "a")], "problem_id bigint, prompt string").coalesce(1)
    assert loaders.lookup_problem(twice, 1).head().prompt == "b"
    with pytest.raises(LookupError):
        loaders.lookup_problem(twice, 3)
    assert loaders.load_problems(spark, [{"prompt": "x", "reference": False}]).head().reference == "False"
    (tmp_path / "d.txt").write_text("")
    with pytest.raises(ValueError):
        loaders.load_problems(spark, str(tmp_path / "d.txt"))
    with pytest.raises(TypeError):
        loaders.load_problems(spark, 5)
    with pytest.raises(NotImplementedError):
        loaders.load_problems(spark, "some/hub")


def test_documents(spark, tmp_path):
    doc = {"source_problem": "s", "n_problems": 1, "problems": [{"problem": "p", "ground_truth_answer": "1", "agreement_rate": 0.7, "all_answers": ["1"], "all_solutions": [], "n_samples": 3}]}
    for run in ("r2", "r1"):
        (tmp_path / run).mkdir()
        sinks.write_document(spark, doc, str(tmp_path / run / "keeps.json"))
    (tmp_path / "r3").mkdir()
    runs = loaders.read_runs(spark, str(tmp_path))
    assert sorted(r.run for r in runs.collect()) == ["r1", "r2"]
    assert rows(C.compiled(loaders.explode_problems(runs)), "prompt") == [("p", "1", 0.7, "r1")]
    assert loaders.read_runs(spark, str(tmp_path), "skips.json").count() == 0
    assert loaders.load_dataset(spark, str(tmp_path / "r1/keeps.json")).head().target_agreement_high == 0.8
    assert loaders.resume_problems(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t1.json").write_text(json.dumps(["", {"reasoning": "why"}, "text"]))
    (tmp_path / "t0.json").write_text("{}")
    assert [r.solution for r in loaders.attempted_solutions(spark, str(tmp_path / "t*.json")).orderBy("pos").collect()] == ["", "why", "text"]
    assert loaders.read_env("# c\nA=1 # x\nB='q # r'\nbad\nC=3", {"C": "9"}) == {"A": "1", "B": "q # r", "C": "9"}
    odd = "\n".join(['D="a" # b', "E='it", "F= # only", "G=a#b", " H = two words  # c", "=x", "I=", "#J=1", "A=2", "A=3", 'K="x=y"'])
    assert loaders.read_env(odd) == {"D": "a", "E": "it", "F": "# only", "G": "a#b", "H": "two words", "": "x", "I": "", "A": "2", "K": "x=y"}
    assert loaders.first_setting(" ", "v", "z") == "v"
    (tmp_path / "res.json").write_text(json.dumps({"mode": "m", "model": "x", "problem": "p", "results": [{"sample_idx": 0, "answer": "5"}, {"sample_idx": 1, "answer": ""}]}))
    assert [(r.model, r.sample_idx, r.answer) for r in loaders.read_results(spark, str(tmp_path / "res.json")).orderBy("sample_idx").collect()] == [("x", 0, "5"), ("x", 1, "")]
    assert loaders.read_results(spark, str(tmp_path / "no*.json")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "x"), (2, False, "y")], "id int, kept boolean, raw_outputs string")
    sinks.write_split(df, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split")).count() == 2
    sinks.write_dual(df, str(tmp_path / "dual"))
    assert "raw_outputs" not in spark.read.json(str(tmp_path / "dual")).columns
    assert loaders.done_ids(spark, str(tmp_path / "dual_full")).count() == 2
    sinks.append_metrics(df, str(tmp_path / "m"))
    sinks.append_metrics(df, str(tmp_path / "m"))
    assert loaders.read_metrics(spark, str(tmp_path / "m")).count() == 4
    assert sinks.dataset_documents(df, ["kept"], "id").count() == 2
    assert sinks.full_name("a/b.json") == "a/b_full.json" and sinks.full_name("a/b") == "a/b_full"
    sinks.write_array(df.union(spark.createDataFrame([(0, None, 'q"')], df.schema)), str(tmp_path / "a.json"), "id")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": 0, "kept": None, "raw_outputs": 'q"'}, {"id": 1, "kept": True, "raw_outputs": "x"}, {"id": 2, "kept": False, "raw_outputs": "y"}]
    sinks.write_array(df.where("false"), str(tmp_path / "a.json"), "id")
    assert json.loads((tmp_path / "a.json").read_text()) == []
    for _ in range(2):
        assert sinks.write_documents(df, str(tmp_path / "docs"), "d.json", "id") == 2
    assert json.loads((tmp_path / "docs" / "1" / "d.json").read_text()) == {"id": 1, "kept": True, "raw_outputs": "x"}
    sinks.write_ordered(df, str(tmp_path / "o"), "id")
    compiled = spark.createDataFrame([("p", "1", 0.5, "r")], "prompt string, reference string, agreement_rate double, source_run string")
    sinks.write_compiled(compiled, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())[0]["source_run"] == "r"


def test_providers(spark):
    class Echo:
        def complete(self, prompt, n):
            if prompt == "bad":
                raise ValueError("no")
            return [f"{prompt}{i}" for i in range(n)]

    p = spark.createDataFrame([(1, "a"), (2, "bad")], "problem_id bigint, prompt string")
    got = rows(providers.complete(p, Echo, 2, tries=1).select("problem_id", "sample_idx", "response", "error"), "problem_id", "sample_idx")
    assert got == [(1, 0, "a0", None), (1, 1, "a1", None), (2, 0, None, "no")]
    table = spark.createDataFrame([(1, 0, "x"), (1, 5, "y")], "problem_id bigint, sample_idx int, response string")
    assert providers.TableProvider(table).answer(p, 3).count() == 1
    class Shy:
        def __init__(self):
            self.asked = {}

        def complete(self, prompt, n):
            self.asked[prompt] = self.asked.get(prompt, 0) + 1
            return ["", "x"][: self.asked[prompt] if prompt == "a" else 1]

    shy = providers.complete(p, Shy, 2, tries=2, accept=lambda r: any(r)).select("problem_id", "sample_idx", "response", "error")
    assert rows(shy, "problem_id", "sample_idx") == [(1, 0, "", None), (1, 1, "x", None), (2, 0, None, "no accepted reply")]

    class Reads:
        def complete(self, prompt, n):
            if "fault" in prompt:
                raise ValueError("no")
            return [" none " if "nothing" in prompt else " 42 "]

    texts = spark.createDataFrame([(1, r"so \boxed{7}"), (2, "it comes to forty-two"), (3, "nothing"), (4, "fault"), (5, ""), (6, None)], "i int, t string")
    assert [r.answer for r in providers.answers_or_ask(texts, "t", Reads).orderBy("i").collect()] == ["7", "42", "", "", "", ""]
    assert [r.answer for r in providers.answers_or_ask(texts, "t").orderBy("i").collect()] == ["7", "", "", "", "", ""]
    waits = []
    assert providers.with_retries(lambda: "", 3, waits.append, bool) == "" and waits == [1.0, 2.0]


def test_documents_of_runs(spark, tmp_path):
    runs = spark.createDataFrame([(1, "m", 4, "5"), (2, "m", 2, ""), (3, "m", 1, "5")], "run_id bigint, model string, n_samples int, reference string")
    results = spark.createDataFrame([(1, 1, 1, "5", None), (2, 1, None, "6", None), (3, 1, 2, "5", None), (4, 1, 3, "", "late"), (5, 2, 0, "", None)], "result_id bigint, run_id bigint, sample_idx int, answer string, error string")
    docs = {r.run_id: r for r in D.run_documents(runs, results, ["sample_idx", "answer"]).collect()}
    assert [r.answer for r in docs[1].results] == ["6", "5", "5", ""] and docs[2].summary is None and docs[3].results == []
    s = docs[1].summary
    assert (s.majority_answer, s.agreement_rate, s.n_valid_answers, s.n_empty, list(s.answer_distribution.items())) == ("5", 0.667, 3, 1, [("5", 2), ("6", 1)])
    docs = {r.run_id: r for r in D.repeat_documents(runs, results, ["sample_idx", "answer"]).collect()}
    assert docs[1].progress.asDict() == {"done": 4, "total": 4, "n_correct": 2, "n_answered": 3, "accuracy": 66.67} and docs[1].completed and docs[1].summary.n_errors == 1
    assert not docs[2].completed and docs[2].summary is None and docs[3].progress.done == 0
    assert sinks.write_documents(D.run_documents(runs, results, ["answer"]), str(tmp_path / "d"), "results.json") == 3
    assert json.loads((tmp_path / "d/1/results.json").read_text())["summary"]["answer_distribution"] == {"5": 2, "6": 1}
    none = results.where("false")
    assert D.run_documents(runs, none, ["answer"]).count() == 3 and D.repeat_documents(runs.where("false"), none, ["answer"]).count() == 0


def test_reactions(spark, tmp_path, capsys):
    problems = spark.createDataFrame([(1, "CC.O", "b"), (2, "N", "a"), (3, "C", None)], "problem_idx bigint, reference string, reaction_type_name string")
    samples = spark.createDataFrame([(1, 1, "CC.O", 1.0), (1, 0, r"\text{CC.O}", 2.0), (2, 0, "", 1.0), (2, 1, "N", None)], "problem_idx bigint, sample_idx int, answer string, elapsed_s double")
    results = D.reaction_results(problems, samples)
    got = {r.problem_idx: (r.n_correct, r.n_samples, r.accuracy, [x.correct for x in r.samples]) for r in results.collect()}
    assert got == {1: (2, 2, 1.0, [True, True]), 2: (1, 2, 0.5, [False, True]), 3: (0, 0, 0.0, [])}
    want = [("(none)", 1, 0, 0, 0, 0), ("a", 1, 1, 0, 1, 2), ("b", 1, 1, 1, 2, 2), (None, 3, 2, 1, 3, 4)]
    assert [tuple(r) for r in D.reaction_report(results, "reaction_type_name").collect()] == want
    problems.withColumnRenamed("problem_idx", "id").write.json(str(tmp_path / "p"))
    samples.withColumnRenamed("problem_idx", "id").write.json(str(tmp_path / "a"))
    main(["reactions", str(tmp_path / "p"), str(tmp_path / "a"), "--out", str(tmp_path / "r.json")], spark)
    assert capsys.readouterr().out.splitlines()[-1] == "\t3\t2\t1\t3\t4" and len(json.loads((tmp_path / "r.json").read_text())) == 3


def test_commands(spark, tmp_path, capsys):
    doc = {"source_problem": "s", "n_problems": 1, "problems": [{"problem": "p", "ground_truth_answer": "1", "agreement_rate": 0.7}]}
    for run in ("r1", "r2"):
        sinks.write_document(spark, doc, str(tmp_path / "runs" / run / "keeps.json"))
    main(["totals", str(tmp_path / "runs")], spark)
    assert capsys.readouterr().out.splitlines()[-3:] == ["r1\t1", "r2\t1", "\t2"]
    main(["compile", str(tmp_path / "runs"), str(tmp_path / "all.json")], spark)
    assert json.loads((tmp_path / "all.json").read_text()) == [{"prompt": "p", "reference": "1", "agreement_rate": 0.7, "source_run": "r1"}]
    sinks.write_document(spark, {"model": "x", "results": [{"sample_idx": 0, "answer": "5"}, {"sample_idx": 1, "answer": ""}]}, str(tmp_path / "res" / "a.json"))
    main(["repeat", str(tmp_path / "res" / "*.json"), "--reference", "5"], spark)
    assert capsys.readouterr().out.splitlines()[-1].split("\t")[1:9] == ["2", "2", "1", "1", "0", "100.0", "5", "1"]


def test_trainer(spark, tmp_path):
    config = rolloom.Config(str(tmp_path / "log"), batch_size=2, epochs=2, save_every=1, system_prompt="Solve.", few_shot=(("user", "q"), ("assistant", "a")), prompt_suffix=" Box it.", sample_rows=1)
    trainer = rolloom.Trainer(spark, config, rolloom.combined((1.0, rolloom.boxed_match), (0.5, rolloom.boxed_format_bonus)))
    assert json.loads((tmp_path / "log/settings.json").read_text())["reward"] == trainer.reward.name
    problems = spark.createDataFrame([(i, f"p{i}", str(i)) for i in range(5)], "problem_id bigint, prompt string, reference string")
    prompts = trainer.prompts(problems)
    assert prompts.count() == 8 and {(r.step, r.save) for r in prompts.collect()} == {(0, False), (1, True), (2, True), (3, True)}
    assert len(prompts.head().messages) == 4 and prompts.head().text.endswith("<|start|>assistant")
    drawn = prompts.where("step = 0").select("step", "problem_id", "prompt", "reference").withColumn("sample_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    rollouts = drawn.withColumn("response", F.when(F.col("sample_idx") == 0, F.format_string("so \\boxed{%s}", "reference")).otherwise("no")).selectExpr("*", "array(1, 2) as prompt_tokens", "array(3, 4) as tokens", "array(-0.1D, -0.2D) as logprobs")
    records = trainer.step(rollouts)
    assert records.count() == 4 and {tuple(r.advantages) for r in records.collect()} == {(0.0, 0.55, 0.55), (0.0, -0.55, -0.55)}
    assert loaders.read_metrics(spark, str(tmp_path / "log/metrics")).head().datums == 4
    assert {(r.predicted, r.correct) for r in spark.read.json(str(tmp_path / "log/samples")).collect()} <= {("0", True), ("1", True), ("(no answer extracted)", False)}
    trainer.log.close()
    with pytest.raises(ValueError):
        trainer.step(rollouts)
    assert set(rolloom.__all__) >= {"Trainer", "load_problems", "combined"} and all(getattr(rolloom, n) for n in rolloom.__all__)


def test_small_helpers(spark):
    df = spark.createDataFrame([("why", "so"), ("", "so"), (None, "so")], "h string, c string")
    assert [tuple(r) for r in df.select(H.with_hidden(F.col("h"), F.col("c")), H.hidden_length(F.col("h"))).collect()] == [("why\n\nso", 3), ("so", None), ("so", None)]
    parts = spark.sql("select array(named_struct('type', 'text', 'text', 'a'), named_struct('type', 'image', 'text', null), named_struct('type', 'text', 'text', 'b')) as p")
    assert tuple(parts.select(H.text_parts(F.col("p")), H.first_text(F.col("p"))).head()) == ("a\nb", "a")
    steps = spark.range(5).select(F.col("id").cast("int").alias("s"))
    assert [r.s for r in steps.where(G.checkpoint_due(F.col("s"), 2, F.lit(4))).orderBy("s").collect()] == [2, 3, 4]
    mixed = D.extended(spark.createDataFrame([(1, "a")], "i int, x string"), spark.createDataFrame([(None, 2.0)], "i int, y double"))
    assert [tuple(r) for r in D.in_order(mixed, "i").collect()] == [(None, None, 2.0), (1, "a", None)]


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files here")
def test_prompts_as_tokens_and_back(spark):
    texts = ["It's a   test: ½ √2, naïve 日本語", "", None, "a\n\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ids", rolloom.token_ids(F.col("t"), VOCABULARY))
    got = df.select("i", "ids", rolloom.decoded(F.col("ids"), VOCABULARY).alias("back")).orderBy("i").collect()
    assert [r.back for r in got] == [t or "" for t in texts] and got[1].ids == got[2].ids == []
    talk = spark.range(1).select(rolloom.rendered(H.messages(F.lit("Hi"), system="Be brief."), VOCABULARY).alias("r")).select("r.*", rolloom.decoded(F.col("r.ids"), VOCABULARY).alias("back")).head()
    assert talk.back == talk.text and talk.text.endswith("<|start|>assistant")


SECOND = """
import sys
from pyspark.sql import SparkSession, functions as F
from rolloom.streaming import incremental
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
score = lambda df: df.withColumn("correct", F.col("v") > 1)
incremental.evaluate_batches(spark.readStream.schema("id bigint, v int").parquet(sys.argv[1]), score, sys.argv[2]).awaitTermination()
"""


def test_a_second_process_goes_on_where_the_first_stopped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    score = lambda df: df.withColumn("correct", F.col("v") > 1)
    spark.createDataFrame([(1, 1), (2, 2)], "id bigint, v int").write.parquet(src)
    incremental.evaluate_batches(spark.readStream.schema("id bigint, v int").parquet(src), score, out).awaitTermination()
    spark.createDataFrame([(3, 3)], "id bigint, v int").write.mode("append").parquet(src)
    root = os.path.dirname(os.path.dirname(os.path.abspath(incremental.__file__)))
    subprocess.run([sys.executable, "-c", SECOND, src, out], check=True, timeout=300, env=os.environ | {"PYTHONPATH": os.path.dirname(root)}, capture_output=True)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    score = lambda df: df.withColumn("correct", F.col("v") > 1)
    for part in ([(1, 1), (2, 2)], [(3, 3)]):
        spark.createDataFrame(part, "id bigint, v int").write.mode("append").parquet(src)
        incremental.evaluate_batches(spark.readStream.schema("id bigint, v int").parquet(src), score, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(incremental.progress(spark, out).select("completed", "accuracy"), "completed") == [(2, 50.0), (3, 66.67)]
    assert incremental.resume(spark.range(5), out, "id").count() == 2
