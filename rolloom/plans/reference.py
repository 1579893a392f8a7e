"""Queries of the rollout operators over the test tables, with equivalent SQL.

Samples stand for scored rollouts (step, problem, sample), results for the replies of inference runs, generated problems for the candidates of the builder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions import extract as X
from rolloom.functions import helpers as H
from rolloom.functions import rewards as R
from rolloom.operators import consistency as C
from rolloom.operators import documents as D
from rolloom.operators import evaluate as E
from rolloom.operators import grpo as G
from rolloom.operators import trainer as T
from rolloom.session import read_table
from rolloom.sources import loaders as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Spaces beyond the ASCII ones, for character classes in SQL.
SPACES = "".join(map(chr, [0xA0, 0x2000])) + "-" + "".join(map(chr, [0x200A, 0x202F, 0x3000]))
SAMPLES = "s as (select distinct sample_id, source, step, problem_id, sample_idx, prompt, response, expected, predicted, reward, correct from samples)"
RESULTS = "r as (select distinct result_id, run_id, source_id, sample_idx, coalesce(answer, '') as answer, reasoning, elapsed_s, error from results)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample once, whatever its deliveries."""
    return read_table(spark, sf, "samples").drop("logged_at").dropDuplicates(["sample_id"])


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Each result once; a missing answer is ""."""
    return read_table(spark, sf, "results").select("result_id", "run_id", "source_id", "sample_idx", F.coalesce("answer", F.lit("")).alias("answer"), "reasoning", "elapsed_s", "error").dropDuplicates(["result_id"])


def of_samples(spark: SparkSession, sf: str, build: Callable[[], Column], name: str) -> DataFrame:
    """(sample_id, a value of the sample's texts), each sample once. Redelivered rows are dropped after the value is formed, so that texts aren't shuffled."""
    return read_table(spark, sf, "samples").select("sample_id", build().alias(name)).dropDuplicates(["sample_id"])


def of_results(spark: SparkSession, sf: str, build: Callable[[Column], Column]) -> DataFrame:
    """(result_id, answer) by a function of the answer, each result once."""
    return read_table(spark, sf, "results").select("result_id", build(F.coalesce("answer", F.lit(""))).alias("answer")).dropDuplicates(["result_id"])


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with 0.0 for -0.0."""
    return F.round(x, digits) + F.lit(0.0)


# ---- training step


@query(f"with {SAMPLES} select step, problem_id, sample_id, round(reward, 6) + 0.0::double as reward, round(reward - avg(reward) over (partition by step, problem_id), 6) + 0.0::double as advantage from s")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    return G.advantages(samples(spark, sf)).select("step", "problem_id", "sample_id", rounded(F.col("reward")).alias("reward"), rounded(F.col("advantage")).alias("advantage"))


@query(
    f"""with {SAMPLES}, a as (select *, reward - avg(reward) over (partition by step, problem_id) as adv, len(regexp_extract_all(coalesce(response, ''), '\\S+')) as tokens from s),
    g as (select step, problem_id, coalesce(min(reward) = max(reward), true) as skip, count(*) as n from s group by all)
    select step, round(avg(reward), 6) as reward_mean, max(reward) as reward_max, min(reward) as reward_min, round(sqrt(avg(adv * adv)), 6) as advantage_std, round(avg(tokens), 6) as tokens_mean,
    (select round(avg(skip::int), 6) from g where g.step = a.step) as skipped_frac, (select sum(case when skip then 0 else n end)::bigint from g where g.step = a.step) as datums from a group by step"""
)
def step_metrics(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.size(F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    rows = read_table(spark, sf, "samples").select("sample_id", "step", "problem_id", "reward", tokens.alias("n_tokens")).dropDuplicates(["sample_id"])
    m = G.step_metrics(rows, F.col("n_tokens"))
    return m.select("step", *[F.round(c, 6).alias(c) for c in ("reward_mean",)], "reward_max", "reward_min", *[F.round(c, 6).alias(c) for c in ("advantage_std", "tokens_mean", "skipped_frac")], "datums")


@query(f"with {SAMPLES} select step, problem_id, sample_id from s qualify min(reward) over (partition by step, problem_id) <> max(reward) over (partition by step, problem_id)")
def degenerate_group_skip(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_signal(samples(spark, sf)).select("step", "problem_id", "sample_id")


@query("with n as (select problem_id, row_number() over (order by problem_id) as rn, count(*) over () as total from problems where prompt <> '') select problem_id, ((rn - 1) // 128)::bigint as batch_idx from n where rn <= total // 128 * 128")
def train_batches_drop_tail(spark: SparkSession, sf: str) -> DataFrame:
    return G.batches(read_table(spark, sf, "problems").where("prompt <> ''").select("problem_id"), "problem_id", 128).select("problem_id", "batch_idx")


@query("select problem_id, ((row_number() over (order by problem_id) - 1) // 5)::bigint as batch_idx from problems where prompt <> ''")
def eval_batches_keep_tail(spark: SparkSession, sf: str) -> DataFrame:
    return G.batches(read_table(spark, sf, "problems").where("prompt <> ''").select("problem_id"), "problem_id", 5, keep_tail=True).select("problem_id", "batch_idx")


@query(
    """with n as (select problem_id, row_number() over (order by problem_id) as rn, count(*) over () as total from problems where prompt <> ''),
    b as (select problem_id, (rn - 1) // 25 as b, total // 25 as nb from n where rn <= total // 25 * 25)
    select problem_id, e.e::int as epoch, (e.e * nb + b)::bigint as step, round((e.e * nb + b + 1) / (nb * 3)::double, 6) as done_frac from b, range(3) e(e)"""
)
def epoch_steps(spark: SparkSession, sf: str) -> DataFrame:
    batched = G.batches(read_table(spark, sf, "problems").where("prompt <> ''").select("problem_id"), "problem_id", 25)
    return G.epoch_steps(batched, 3).select("problem_id", "epoch", "step", F.round("done_frac", 6).alias("done_frac"))


@query(
    """select vec_id, list_concat(list_transform(range(label), lambda x: 7::int), list_transform(embedding[:-2], lambda x: round(x * 100)::int)) as input, list_concat(list_transform(range(greatest(label - 1, 0)), lambda x: 0::int), list_transform(embedding, lambda x: round(x * 100)::int)) as target_tokens
    from embeddings"""
)
def pad_datums(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    tokens = F.transform("embedding", lambda x: F.round(x * 100).cast("int"))
    d = H.padded(F.array_repeat(F.lit(7), F.col("label")), tokens, F.transform("embedding", lambda x: x.cast("double")), F.lit(0.5))
    return e.select("vec_id", d.alias("d")).select("vec_id", "d.input", "d.target_tokens")


@query(f"with {SAMPLES} select least(greatest(floor(reward / 0.1)::int + 1, 0), 11)::bigint as bin, count(*) as n from s where reward is not null group by 1")
def reward_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return G.histogram(samples(spark, sf), "reward", 0.0, 1.0, 10)


@query(f"with {SAMPLES} select sample_id, coalesce(reward >= 1.0, false) as correct from s")
def correct_flag(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample_id", F.coalesce(F.col("reward") >= 1.0, F.lit(False)).alias("correct"))


# ---- votes and gates

VOTES = f"with {RESULTS}, c as (select run_id, answer, count(*) as n, min(result_id) as f from r group by all)"


@query(f"{VOTES} select run_id, first(answer order by n desc, f) as majority, max(n) as votes, sum(n)::bigint as total from c group by run_id")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return C.majority(results(spark, sf), ["run_id"], "answer", "result_id")


@query(f"{VOTES} select run_id, answer, n, (row_number() over (partition by run_id order by n desc, f) - 1)::int as place from c")
def answer_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution(results(spark, sf), ["run_id"], "answer", "result_id").select("run_id", F.posexplode("distribution").alias("place", "d")).select("run_id", "d.answer", "d.n", "place")


@query(f"{VOTES} select run_id, round(max(n) / sum(n), 6) as agreement_rate from c group by run_id")
def agreement_all(spark: SparkSession, sf: str) -> DataFrame:
    return C.agreement_all(results(spark, sf), ["run_id"], "answer", "result_id").select("run_id", F.round("agreement_rate", 6).alias("agreement_rate"))


@query(
    f"""{VOTES}, v as (select run_id, first(answer order by n desc, f) as a, round(max(n) / sum(n), 3) as q, sum(n)::bigint as nv from c where answer <> '' group by run_id), t as (select run_id, sum(n)::bigint as total from c group by run_id)
    select run_id, coalesce(a, '') as majority_answer, coalesce(q, 0.0) as agreement_rate, coalesce(nv, 0) as n_valid, total - coalesce(nv, 0) as n_empty from t left join v using (run_id)"""
)
def agreement_valid(spark: SparkSession, sf: str) -> DataFrame:
    return C.agreement_valid(results(spark, sf), ["run_id"], "answer", "result_id")


GATE = "regexp_matches(replace(regexp_replace(lower(ground_truth_answer), '[\\s\\\\${}%s]+', '', 'g'), ',', '.'), '^[+-]?(\\d{1,10}\\.?\\d*|\\.\\d+)(/\\d+)?$')" % SPACES


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "generated_problems").withColumn("gate", X.gate_answer(F.col("ground_truth_answer")))


@query(f"select gen_id, case when coalesce(ground_truth_answer, '') = '' then 'skip (empty answer)' when not {GATE} then 'skip (non-numeric: ' || left(ground_truth_answer, 40) || ')' when agreement_rate between 0.6::double and 0.8::double then 'KEEP' else 'skip' end as status from generated_problems")
def keep_gate_status(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("gen_id", C.gate_status(F.col("agreement_rate"), F.col("ground_truth_answer"), F.col("gate")).alias("status"))


@query(
    f"""with g as (select gen_id, coalesce(agreement_rate between 0.6::double and 0.8::double and ground_truth_answer <> '' and {GATE}, false) as keep from generated_problems)
    select gen_id, keep from (select *, sum(keep::int) over (order by gen_id rows between unbounded preceding and 1 preceding) as before from g) where coalesce(before, 0) < 40"""
)
def keep_until_target(spark: SparkSession, sf: str) -> DataFrame:
    g = _gated(spark, sf).select("gen_id", C.keep_gate(F.col("agreement_rate"), F.col("ground_truth_answer"), F.col("gate")).alias("keep"))
    return C.until_target(g, "keep", "gen_id", 40)


@query("select coalesce(avg(agreement_rate), 0) as mean_agreement, count(*) as kept from generated_problems where kept")
def mean_kept_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "generated_problems").where("kept").agg(F.coalesce(F.avg("agreement_rate"), F.lit(0.0)).alias("mean_agreement"), F.count(F.lit(1)).alias("kept")).withColumn("mean_agreement", F.round("mean_agreement", 6))


SQL["mean_kept_agreement"] = SQL["mean_kept_agreement"].replace("coalesce(avg(agreement_rate), 0)", "round(coalesce(avg(agreement_rate), 0.0::double), 6)")
STRIP = "regexp_replace({}, '^[\\s%s]+|[\\s%s]+$', '', 'g')" % (SPACES, SPACES)


@query(f"select min(gen_id) as gen_id from generated_problems where {STRIP.format('problem')} <> '' group by {STRIP.format('problem')}")
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_wins(read_table(spark, sf, "generated_problems"), "problem", ["gen_id"]).select("gen_id")


@query(
    f"""select {STRIP.format('problem')} as prompt, coalesce(ground_truth_answer, '') as reference, agreement_rate, coalesce(source_run, '(none)') as source_run from generated_problems where kept and {STRIP.format('problem')} <> ''
    qualify row_number() over (partition by {STRIP.format('problem')} order by coalesce(source_run, '(none)'), gen_id) = 1"""
)
def compile_problems(spark: SparkSession, sf: str) -> DataFrame:
    g = read_table(spark, sf, "generated_problems").where("kept")
    return C.compiled(g.withColumn("path", F.concat(F.lit("/runs/"), F.coalesce("source_run", F.lit("(none)")), F.lit("/keeps.json"))).withColumn("pos", F.col("gen_id")))


@query(f"select min(gen_id) as gen_id from generated_problems g where {STRIP.format('problem')} <> '' and not exists (select 1 from problems p where p.prompt = g.problem) group by {STRIP.format('problem')}")
def unseen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    seen = read_table(spark, sf, "problems").select(F.col("prompt").alias("problem"))
    return C.unseen(read_table(spark, sf, "generated_problems"), seen, "problem", ["gen_id"]).select("gen_id")


@query("select coalesce(source_run, '(none)') as source_run, sum(coalesce(n_samples, 0))::bigint as n_problems from generated_problems group by all union all select null, sum(coalesce(n_samples, 0))::bigint from generated_problems")
def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.run_totals(read_table(spark, sf, "generated_problems").withColumn("source_run", F.coalesce("source_run", F.lit("(none)"))), "source_run", "n_samples")


@query("with n as (select source_id, row_number() over (order by source_id) - 1 as rn, count(*) over () as total from source_problems) select pick, source_id from range(200) p(pick) join n on ('0x' || substr(md5('0:' || pick::varchar), 1, 12))::bigint % total = rn")
def random_picks(spark: SparkSession, sf: str) -> DataFrame:
    return C.random_picks(read_table(spark, sf, "source_problems"), "source_id", 200).select("pick", "source_id")


# ---- extraction; responses of samples


def _extract(name: str, build: Callable[[Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return of_samples(spark, sf, lambda: build(F.col("response")), "answer")

    run.__name__ = name
    query(f"with {SAMPLES} {sql}" if sql else None)(run)


BOXED = """t as (select sample_id, response, case when contains(response, '\\boxed{') then list_last(string_split(response, '\\boxed{')) end as tail from s),
c as (select sample_id, tail, i, substr(tail, i, 1) as ch from (select sample_id, tail, unnest(range(1, length(tail) + 1)) as i from t)),
d as (select sample_id, i, 1 + sum(case ch when '{' then 1 when '}' then -1 else 0 end) over (partition by sample_id order by i) as depth from c),
e as (select sample_id, min(i) as i from d where depth = 0 group by 1),
x as (select t.sample_id, t.response, """ + STRIP.format("substr(tail, 1, e.i - 1)") + """ as boxed,
""" + STRIP.format("list_last(regexp_extract_all(response, '\\\\boxed\\{([^}]+)\\}', 1))") + """ as flat,
""" + STRIP.format("list_last(regexp_extract_all(response, '(?i)\\*\\*ANSWER:\\s*([^\\n]+?)\\*\\*', 1))") + """ as tag,
case when regexp_matches(response, '(?i)(?:final answer|the answer)(?:\\s+is)?[:\\s]+([^\\n.]+)') then """ + STRIP.format("regexp_extract(response, '(?i)(?:final answer|the answer)(?:\\s+is)?[:\\s]+([^\\n.]+)', 1)") + """ end as phrase
from t left join e on e.sample_id = t.sample_id)"""

_extract("extract_boxed", X.boxed, f", {BOXED} select sample_id, boxed as answer from x")
_extract("extract_boxed_or_empty", X.boxed_or_empty, f", {BOXED} select sample_id, case when response is not null then coalesce(boxed, '') end as answer from x")
_extract("extract_boxed_flat", X.flat_boxed, f", {BOXED} select sample_id, flat as answer from x")
_extract("extract_answer_tag", X.answer_tag, f", {BOXED} select sample_id, tag as answer from x")
_extract("extract_final_phrase", X.final_phrase, f", {BOXED} select sample_id, phrase as answer from x")
_extract("extract_chain_tag_first", X.chain_tag_first, f", {BOXED} select sample_id, case when response is not null then coalesce(tag, flat, phrase, '') end as answer from x")
_extract("extract_chain_box_first", X.chain_box_first, f", {BOXED} select sample_id, case when response is not null then coalesce(nullif(boxed, ''), tag, phrase, '') end as answer from x")
_extract("extract_display", X.chain_display, f", {BOXED} select sample_id, coalesce(tag, boxed, '(no answer extracted)') as answer from x")


def number_sql(x: str) -> str:
    plain = f"regexp_replace({STRIP.format(f'''replace(replace({x}, ',', ''), ' ', '')''')}, '\\.+$', '')"
    return f"case when regexp_full_match({plain}, '[+-]?[0-9]{{1,9}}(\\.[0-9]{{1,5}})?') then case when try_cast({plain} as double) = trunc(try_cast({plain} as double)) then (try_cast({plain} as double)::bigint)::varchar else (try_cast({plain} as double))::varchar end else {plain} end"


@query(f"with {RESULTS} select result_id, {number_sql('answer')} as answer from r")
def normalize_number(spark: SparkSession, sf: str) -> DataFrame:
    return of_results(spark, sf, X.normal_number)


NOISE = r"\\(?:displaystyle|bigl?|Bigl?|bigr?|Bigr?|left|right|text\{[^}]*\}|lfloor|rfloor|,|;| )"


def clean_sql(x: str) -> str:
    last = f"list_last(string_split({x}, '='))"
    return number_sql(STRIP.format(f"regexp_replace({last}, '{NOISE}', '', 'g')"))


CLEANED = f"coalesce(nullif({clean_sql('boxed')}, ''), nullif(boxed, ''), phrase, '')"
_extract("extract_chain_cleaned", X.chain_cleaned, f", {BOXED} select sample_id, case when response is not null then {CLEANED} end as answer from x")
_extract("extract_chain_checked", X.chain_cleaned_checked, f", {BOXED}, z as (select sample_id, case when response is not null then {CLEANED} end as a from x) select sample_id, case when contains(a, '<') and contains(a, '>') then '' else a end as answer from z")


@query(f"with {RESULTS} select result_id, {clean_sql('answer')} as answer from r")
def normalize_clean_boxed(spark: SparkSession, sf: str) -> DataFrame:
    return of_results(spark, sf, X.clean_boxed)


GATED = GATE[len("regexp_matches(") : GATE.index(", '^[+-]?(")]
TEN_DIGITS = (
    "case when regexp_full_match(g, '-?(\\d+\\.?\\d*|\\.\\d+)') then format('{:.10g}', g::double) when regexp_full_match(g, '-?\\d+/\\d*[1-9]\\d*') "
    "then format('{:.10g}', split_part(g, '/', 1)::double / split_part(g, '/', 2)::double) else g end"
)


@query(f"with c as (select gen_id, {GATED} as g from generated_problems), d as (select gen_id, {TEN_DIGITS} as gate from c) select gen_id, gate, regexp_matches(gate, '^[+-]?\\d+([.,]\\d+)?(/\\d+)?$') as numeric from d")
def normalize_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("gen_id", "gate", X.is_numeric(F.col("gate")).alias("numeric"))


@query(f"with {RESULTS} select result_id, case when contains(answer, '<') and contains(answer, '>') then '' else answer end as answer from r")
def placeholder_reject(spark: SparkSession, sf: str) -> DataFrame:
    return of_results(spark, sf, X.reject_placeholder)


# ---- rewards; response against expected of samples

REWARD = f"with {SAMPLES}, {BOXED}, y as (select x.*, coalesce(s.expected, '') as ref, coalesce(s.response, '') as resp from x join s on s.sample_id = x.sample_id)"
REF, HASHES = number_sql("ref"), number_sql(f"list_last(string_split({number_sql('ref')}, '####'))")


def _reward(name: str, reward: R.Reward, sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return of_samples(spark, sf, lambda: rounded(reward(F.col("response"), F.col("expected"))), "reward")

    run.__name__ = name
    query(f"{REWARD} select sample_id, ({sql})::double as reward from y" if sql else None)(run)


@query(f"""with {SAMPLES}, {BOXED}, y as (select x.sample_id, x.boxed, coalesce(p.reference, '') as ref from x join s on s.sample_id = x.sample_id join problems p on p.problem_id = s.problem_id)
    select sample_id, case when coalesce({number_sql('boxed')} = {HASHES}, false) then 1.0::double else 0.0::double end as reward from y""")
def reward_of_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Boxed answers against the references of their problems; the answers are drawn out before the join, so that it moves no texts."""
    drawn = read_table(spark, sf, "samples").select("sample_id", "problem_id", X.normal_number(X.boxed(F.col("response"))).alias("box")).dropDuplicates(["sample_id"])
    wanted = read_table(spark, sf, "problems").select("problem_id", X.after_hashes(X.normal_number(F.coalesce("reference", F.lit("")))).alias("want"))
    return drawn.join(wanted, "problem_id").select("sample_id", F.coalesce(F.col("box") == F.col("want"), F.lit(False)).cast("double").alias("reward"))


WORDS = "len(regexp_extract_all(resp, '[^\\s%s]+'))" % SPACES
SQL_BOXED = f"case when coalesce({number_sql('boxed')} = {HASHES}, false) then 1.0 else 0.0 end"
_reward("reward_exact", R.exact_match, f"case when {REF} <> '' and contains({number_sql('resp')}, {REF}) then 1.0 else 0.0 end")
_reward("reward_boxed", R.boxed_match, SQL_BOXED)
_reward("reward_format", R.boxed_format_bonus, "case when boxed is not null then 0.1 else -0.1 end")
_reward("reward_contains", R.contains_reference, "case when ref <> '' and contains(lower(resp), lower(ref)) then 1.0 else 0.0 end")
_reward("reward_tag", R.answer_tag_match, f"case when coalesce({number_sql('tag')} = {REF}, false) then 1.0 else 0.0 end")
_reward("reward_tag_format", R.answer_tag_format_bonus, "case when tag is not null then 0.1 else -0.1 end")
_reward("reward_regex", R.regex_match(r"final.{0,40}\d"), "case when regexp_matches(resp, '(?s)final.{0,40}\\d') then 1.0 else 0.0 end")
_reward("reward_length", R.length_penalty(100, 0.001), f"round(-0.001::double * greatest(0, {WORDS} - 100), 6) + 0.0::double")
_reward("reward_combined", R.combined((1.0, R.boxed_match), (0.5, R.boxed_format_bonus)), f"round(1.0 * ({SQL_BOXED}) + 0.5 * (case when boxed is not null then 0.1 else -0.1 end), 6)")

# without a chemistry library molecules are compared as texts
PLAIN_BOX = STRIP.format("replace(regexp_replace(boxed, '\\\\(?:text|texttt|textbf|mathrm|mathtt)\\{([^}]*)\\}', '\\1', 'g'), '\\,', '')")
_reward("reward_smiles", R.smiles_match, f"case when coalesce({PLAIN_BOX} = {STRIP.format('ref')}, false) then 1.0 else 0.0 end")


@query(f"""with {SAMPLES} select sample_id, coalesce(predicted <> '' and {STRIP.format("regexp_replace(predicted, '\\\\text\\{([^}]*)\\}', '\\1', 'g')")} = {STRIP.format('expected')}, false) as correct from s""")
def molecule_check(spark: SparkSession, sf: str) -> DataFrame:
    return of_samples(spark, sf, lambda: R.check_correct(F.col("predicted"), F.col("expected")), "correct")


# ---- evaluation

ANSWERED = f"with {RESULTS}, j as (select r.*, m.model, p.reference from r join infer_runs m using (run_id) join source_problems p on p.source_id = r.source_id)"
MODELS = ["oak-120b", "fern-20b", "moss-7b", "fern-20b-ckpt", "sedge-mini", "reed-large"]


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Results with their model and the reference of their problem. source_problems is fixed at 60 rows."""
    runs = read_table(spark, sf, "infer_runs").select("run_id", "model")
    return results(spark, sf).join(runs, "run_id").join(F.broadcast(read_table(spark, sf, "source_problems").select("source_id", "reference")), "source_id")


PLACE = "coalesce(nullif(list_position([" + ", ".join(f"'{m}'" for m in MODELS) + "], model), 0), 7)"
BEST = f"{ANSWERED}, c as (select source_id, model, answer, count(*) as n, min(result_id) as f from j where answer <> '' group by all), b as (select source_id, model, first(answer order by n desc, f) as best from c group by all)"


@query(f"{BEST}, v as (select source_id, best, count(*) as n, min({PLACE}) as p from b group by all) select source_id, first(best order by n desc, p) as majority_vote, max(n) as model_votes from v group by source_id")
def two_level_vote(spark: SparkSession, sf: str) -> DataFrame:
    return E.two_level_vote(answered(spark, sf), "source_id", "model", "answer", "result_id", MODELS)


@query(f"{ANSWERED} select model, count(*) as n, sum((answer = reference)::int)::bigint as correct, round(100 * avg((answer = reference)::int::double), 2) as accuracy from j where answer <> '' group by model")
def model_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return E.model_accuracy(answered(spark, sf), "model", "answer", "reference")


@query(f"{BEST} select source_id, count(*) as n_models, count(distinct best) as n_answers, case when count(distinct best) > 1 then 'disagree' when count(*) > 1 then 'agree' end as verdict from b group by source_id")
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    best = C.majority(answered(spark, sf).where("answer <> ''"), ["source_id", "model"], "answer", "result_id")
    return E.model_agreement(best, "source_id", "model", "majority")


@query(f"{ANSWERED} select count(*) as n, coalesce(round(100 * avg((answer = reference)::int::double), 2), 0.0) as accuracy from j")
def accuracy_evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).agg(F.count(F.lit(1)).alias("n"), E.percent_correct(F.col("answer") == F.col("reference")).alias("accuracy"))


@query(f"{ANSWERED}, k as (select source_id, count(*) as n, sum((answer <> '')::int)::bigint as answered, sum((answer <> '' and answer = reference and reference <> '')::int)::bigint as correct from j group by 1) select *, case when answered > 0 then round(100.0::double * correct / answered, 2) else 0.0 end as accuracy from k")
def accuracy_answered(spark: SparkSession, sf: str) -> DataFrame:
    return E.accuracy_answered(answered(spark, sf), ["source_id"], "answer", "reference")


PER_PROBLEM = f"with {SAMPLES}, q as (select problem_id, sum(correct::int)::bigint as n_correct, count(*) as n_samples from s group by 1)"


def per_problem(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).groupBy("problem_id").agg(F.sum(F.col("correct").cast("int")).alias("n_correct"), F.count(F.lit(1)).alias("n_samples"))


@query(f"{PER_PROBLEM} select problem_id, round(n_correct / n_samples, 6) as accuracy from q")
def accuracy_per_problem(spark: SparkSession, sf: str) -> DataFrame:
    return per_problem(spark, sf).select("problem_id", F.round(F.col("n_correct") / F.col("n_samples"), 6).alias("accuracy"))


@query(f"{PER_PROBLEM} select count(*) as problems, round(avg((n_correct > 0)::int), 6) as any_rate, round(avg((n_correct = n_samples)::int), 6) as all_rate, round(sum(n_correct) / sum(n_samples), 6) as sample_rate from q")
def any_all_sample_rates(spark: SparkSession, sf: str) -> DataFrame:
    return E.any_all_rates(per_problem(spark, sf)).select("problems", *[F.round(c, 6).alias(c) for c in ("any_rate", "all_rate", "sample_rate")])


@query(f"{PER_PROBLEM} select coalesce(p.source, '(none)') as source, sum((n_correct > 0)::int)::bigint as passed, count(*) as problems from q join problems p using (problem_id) group by 1")
def pass_by_group(spark: SparkSession, sf: str) -> DataFrame:
    source = read_table(spark, sf, "problems").select("problem_id", F.coalesce("source", F.lit("(none)")).alias("source"))
    return E.pass_by_group(per_problem(spark, sf).join(source, "problem_id"), "source")


@query(
    f"""with {SAMPLES}, n as (select correct, ((row_number() over (order by sample_id) - 1) // 50)::bigint as batch_idx from s), b as (select batch_idx, count(*) as n, sum(correct::int)::bigint as n_correct from n group by 1)
    select batch_idx, n, n_correct, sum(n) over w ::bigint as completed, round(100 * (sum(n_correct) over w)::double / sum(n) over w, 2) as accuracy from b window w as (order by batch_idx)"""
)
def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    batched = G.batches(samples(spark, sf).select("sample_id", "correct"), "sample_id", 50, keep_tail=True)
    return E.running_accuracy(batched, "batch_idx", F.col("correct"))


@query("select doc_id from documents where doc_id not in (select doc_id from subject_labels where doc_id is not null)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return E.remaining(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "subject_labels"), "doc_id")


@query(f"{ANSWERED}, a as (select answer, count(*) as n from j where model = 'oak-120b' and answer <> '' group by 1), b as (select answer, count(*) as n from j where model = 'fern-20b' and answer <> '' group by 1) select coalesce(a.answer, b.answer) as answer, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b on a.answer = b.answer")
def answer_counts_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    rows = answered(spark, sf).where("answer <> ''")
    return E.compare_counts(rows.where("model = 'oak-120b'"), rows.where("model = 'fern-20b'"), "answer")


@query(
    f"""{ANSWERED}, c as (select model, answer, count(*) as n, min(result_id) as f from j where answer <> '' and model in ('oak-120b', 'fern-20b') group by all), k as (select * from c qualify row_number() over (partition by model order by n desc, f) <= 15),
    u as (select distinct answer from k) select u.answer, sum(c.n)::bigint as total, row_number() over (order by case u.answer when '214' then 1 when '500' then 2 else 3 end, sum(c.n) desc, u.answer) as place from u join c on c.answer = u.answer group by u.answer"""
)
def top_k_union_pinned(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = answered(spark, sf).where("answer <> '' and model in ('oak-120b', 'fern-20b')")
    top = E.top_answers(rows, ["model"], "answer", "result_id").select("answer").distinct()  # at most 15 for each of two models
    total = rows.join(F.broadcast(top), "answer").groupBy("answer").agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("place", F.row_number().over(Window.orderBy(*E.pinned_order(F.col("answer"), F.col("total"), ["214", "500"]))).cast("bigint"))


@query("select source_id, p.p as provider, i.i::int as sample_idx from source_problems, (values ('a'), ('b'), ('c')) p(p), range(3) i(i)")
def crossjoin_samples(spark: SparkSession, sf: str) -> DataFrame:
    return E.sample_grid(read_table(spark, sf, "source_problems").select("source_id"), 3, ["a", "b", "c"])


@query("select problem_id, prompt, coalesce(reference, 'None') as reference from problems where prompt <> '' order by problem_id limit 100")
def problems_select_limit(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "problems").where("prompt <> ''").select("problem_id", "prompt", F.coalesce("reference", F.lit("None")).alias("reference"))
    return p.orderBy("problem_id").limit(100)


@query("select problem_id, coalesce(element_at(meta, 'level')[1], '') as level, coalesce(len(map_keys(meta)), 0)::int as n_meta from problems")
def meta_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "problems").select("problem_id", F.coalesce(F.try_element_at("meta", F.lit("level")), F.lit("")).alias("level"), F.coalesce(F.size(F.map_keys("meta")), F.lit(0)).alias("n_meta"))


@query(f"with {RESULTS} select count(*) as n, sum((answer <> '')::int)::bigint as answered, sum((coalesce(error, '') <> '')::int)::bigint as errors from r")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer") != "").alias("answered"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))


@query("select gen_id, list_transform(range(1, least(len(all_answers), len(all_solutions)) + 1), lambda i: coalesce(all_answers[i], '') || '|' || coalesce(all_solutions[i], '')) as pairs from generated_problems where all_solutions is not null and all_answers is not null")
def zip_answers(spark: SparkSession, sf: str) -> DataFrame:
    g = read_table(spark, sf, "generated_problems").where("all_solutions is not null and all_answers is not null")
    both = H.zipped(F.col("all_answers"), F.col("all_solutions"))
    return g.select("gen_id", F.transform(both, lambda z: F.concat(F.coalesce(z["all_answers"], F.lit("")), F.lit("|"), F.coalesce(z["all_solutions"], F.lit("")))).alias("pairs"))


@query("select problem_id, '<|start|>system<|message|>Solve.<|end|><|start|>user<|message|>' || coalesce(prompt, '') || ' Answer in a box.<|end|><|start|>assistant' as text from problems")
def chat_template(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "problems").select("problem_id", H.chat_text(H.messages(F.col("prompt"), " Answer in a box.", "Solve.")).alias("text"))


@query("select problem_id, 'Solve {this}: ' || coalesce(prompt, '') as text from problems")
def prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "problems").select("problem_id", H.fill("Solve {{this}}: {problem}", problem=F.col("prompt")).alias("text"))


@query("select run_id, strftime(started_at, '%Y%m%d_%H%M%S') as label, round(total_time_s, 1) as seconds from infer_runs")
def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "infer_runs").select("run_id", H.run_id(F.col("started_at")).alias("label"), F.round("total_time_s", 1).alias("seconds"))


@query("select run_id, model from infer_runs where model = 'oak-120b' and completed = n_samples and finished_at is not null order by finished_at desc, run_id limit 25")
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    listing = read_table(spark, sf, "infer_runs").where("completed = n_samples and finished_at is not null and model = 'oak-120b'").select("run_id", "model", F.lit("training").alias("checkpoint_type"), F.col("run_id").alias("path"), F.col("finished_at").alias("time"))
    return E.checkpoints(listing).select("run_id", "model")


@query(f"with m as ({SQL['step_metrics']}) select step, 'lr' as name, 4e-5::double as value from m union all select step, 'reward_mean', reward_mean from m union all select step, 'advantage_std', advantage_std from m")
def metrics_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Step metrics as one map a step: computed values win over the optimizer's."""
    m = step_metrics(spark, sf)
    optimizer = F.create_map(F.lit("lr"), F.lit(4e-5), F.lit("reward_mean"), F.lit(-1.0))
    own = F.create_map(F.lit("reward_mean"), F.col("reward_mean"), F.lit("advantage_std"), F.col("advantage_std"))
    return m.select("step", F.explode(H.merged(optimizer, own)).alias("name", "value"))


# ---- records and documents


@query(f"""with {SAMPLES}, t as (select *, list_transform(regexp_extract_all(coalesce(prompt, ''), '\\S+'), lambda x: length(x)::int) as p, list_transform(regexp_extract_all(coalesce(response, ''), '\\S+'), lambda x: length(x)::int) as r from s),
    a as (select *, reward - avg(reward) over w as adv from t window w as (partition by step, problem_id) qualify min(reward) over w <> max(reward) over w)
    select sample_id, list_concat(p, r[:-2]) as input, list_concat(list_transform(range(greatest(len(p) - 1, 0)), lambda x: 0::int), r) as target_tokens, len(p)::int - (len(p) > 0)::int as n_masked, case when len(r) > 0 then round(adv, 6) + 0.0::double when len(p) > 1 then 0.0::double end as advantage from a""")
def training_records(spark: SparkSession, sf: str) -> DataFrame:
    """Padded records of the groups with signal; a word's token is its length here."""
    token = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0)), F.length)
    rows = read_table(spark, sf, "samples").select("sample_id", "step", "problem_id", "sample_idx", "reward", token("prompt").alias("prompt_tokens"), token("response").alias("tokens")).dropDuplicates(["sample_id"])
    d = G.datums(rows.withColumn("logprobs", F.transform("tokens", lambda x: F.lit(-0.5))), "sample_id")
    masked = F.size("advantages") - F.size(F.filter("logprobs", lambda x: x != 0))
    return d.select("sample_id", "input", "target_tokens", masked.alias("n_masked"), rounded(F.try_element_at("advantages", F.lit(-1))).alias("advantage"))


@query(f"with {SAMPLES} select step, prompt, response, expected, predicted, reward, correct from s qualify row_number() over (partition by step order by sample_id) <= 10")
def samples_table(spark: SparkSession, sf: str) -> DataFrame:
    return T.samples_table(read_table(spark, sf, "samples").dropDuplicates(["sample_id"]), 10)


SUMMARY = f"{VOTES}, v as (select run_id, first(answer order by n desc, f) as majority_answer, max(n) as top, sum(n)::bigint as n_valid_answers, count(*) as n_distinct from c where answer <> '' group by run_id)"


@query(f"{SUMMARY} select run_id, majority_answer, round(top / n_valid_answers, 3) as agreement_rate, n_valid_answers, m.n_samples - n_valid_answers as n_empty, n_distinct from v join infer_runs m using (run_id)")
def run_document_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries of run documents; of the distribution its number of answers."""
    runs = read_table(spark, sf, "infer_runs")
    documents = D.run_documents(runs, results(spark, sf), ["sample_idx", "answer", "error"])
    return documents.where("summary is not null").select("run_id", "summary.*").withColumn("n_distinct", F.size("answer_distribution").cast("bigint")).drop("answer_distribution")


@query(
    f"""with {RESULTS}, k as (select m.run_id, m.n_samples, coalesce(p.reference, '') as reference from infer_runs m left join source_problems p using (source_id))
    select k.run_id, count(result_id) as done, any_value(n_samples) as total, coalesce(sum((answer <> '' and answer = reference and reference <> '')::int), 0)::bigint as n_correct, coalesce(sum((answer <> '')::int), 0)::bigint as n_answered,
    coalesce(sum((coalesce(error, '') <> '')::int), 0)::bigint as n_errors, coalesce(round(100.0::double * sum((answer <> '' and answer = reference and reference <> '')::int) / nullif(sum((answer <> '')::int), 0), 2), 0.0::double) as accuracy
    from k left join r using (run_id) group by k.run_id"""
)
def repeat_progress(spark: SparkSession, sf: str) -> DataFrame:
    reference = F.broadcast(read_table(spark, sf, "source_problems").select("source_id", "reference"))  # 60 rows, fixed
    runs = read_table(spark, sf, "infer_runs").select("run_id", "source_id", "n_samples").join(reference, "source_id", "left").select("run_id", "n_samples", F.coalesce("reference", F.lit("")).alias("reference"))
    return D.repeat_progress(results(spark, sf), runs)


@query(
    f"""with {SAMPLES}, j as (select p.problem_id, coalesce(p.source, '(none)') as source, coalesce(s.predicted, '') <> '' and {STRIP.format("regexp_replace(s.predicted, '\\\\text\\{{([^}}]*)\\}}', '\\1', 'g')")} = {STRIP.format('p.reference')} as ok, s.sample_id from problems p left join s using (problem_id)),
    q as (select problem_id, source, coalesce(sum(coalesce(ok, false)::int), 0)::bigint as c, count(sample_id) as n from j group by all)
    select source, count(*) as problems, sum((c > 0)::int)::bigint as any_correct, sum((c = n and n > 0)::int)::bigint as all_correct, sum(c)::bigint as n_correct, sum(n)::bigint as n_samples from q group by rollup(source)"""
)
def reaction_report(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of samples against their problems' references, compared as molecules, by source."""
    problems = read_table(spark, sf, "problems").select(F.col("problem_id").alias("problem_idx"), "reference", "source")
    answers = read_table(spark, sf, "samples").dropDuplicates(["sample_id"]).select(F.col("problem_id").alias("problem_idx"), "sample_idx", F.col("predicted").alias("answer"), F.lit(None).cast("double").alias("elapsed_s"))
    return D.reaction_report(D.reaction_results(problems, answers), "source")


@query(f"with {RESULTS} select result_id, coalesce(sample_idx, 0) as place, answer, null::double as reward from r union all by name select sample_id as result_id, coalesce(sample_idx, 0) as place, coalesce(predicted, '') as answer, reward from (select distinct sample_id, sample_idx, predicted, reward from samples)")
def results_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Results and samples one after the other, by their sample index."""
    place = F.coalesce("sample_idx", F.lit(0)).alias("place")
    drawn = read_table(spark, sf, "samples").dropDuplicates(["sample_id"]).select(F.col("sample_id").alias("result_id"), place, F.coalesce("predicted", F.lit("")).alias("answer"), "reward")
    both = D.extended(results(spark, sf).select("result_id", place, "answer"), drawn)
    return D.in_order(both, "place", "result_id")


# ---- sources and small functions


@query("select prompt, coalesce(reference, 'None') as reference, element_at(meta, 'level')[1] as level_in_meta from (select prompt, reference, meta from problems) where prompt <> ''")
def load_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """Problems loaded from a table; other columns become entries of meta."""
    table = read_table(spark, sf, "problems").select("prompt", "reference", F.try_element_at("meta", F.lit("level")).alias("level"))
    return L.load_problems(spark, table).select("prompt", "reference", F.element_at("meta", "level").alias("level_in_meta"))


@query("select problem_id, prompt, coalesce(reference, '') as reference, coalesce(element_at(meta, 'level')[1], '') as level from problems where problem_id = (select min(problem_id) from problems)")
def problem_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One problem by its id, with an entry of its meta."""
    p = read_table(spark, sf, "problems").withColumns({"reference": F.coalesce("reference", F.lit("")), "meta": F.map_concat(F.create_map(F.lit("level"), F.coalesce(F.try_element_at("meta", F.lit("level")), F.lit(""))))})
    first = p.agg(F.min("problem_id")).head()[0]
    return L.lookup_problem(p, first).select("problem_id", *[L.field(k).alias(k) for k in ("prompt", "reference", "level")])


@query(f"select gen_id, {STRIP.format('problem')} as block from generated_problems where {STRIP.format('problem')} <> ''")
def extract_problem_block(spark: SparkSession, sf: str) -> DataFrame:
    """The first block between START and END lines, with another behind it."""
    text = F.concat(F.lit("x\n===  PROBLEM  START===\n"), "problem", F.lit("\n=== PROBLEM END ===\n=== PROBLEM START ===\nno\n=== PROBLEM END ==="))
    return read_table(spark, sf, "generated_problems").where(X.strip(F.col("problem")) != "").select("gen_id", X.problem_block(text).alias("block"))


@query(f"with {RESULTS} select result_id, " + STRIP.format("replace(regexp_replace(" + STRIP.format("answer") + ", '\\\\(?:text|texttt|textbf|mathrm|mathtt)\\{([^}]*)\\}', '\\1', 'g'), '\\,', '')") + " as answer from r")
def strip_latex(spark: SparkSession, sf: str) -> DataFrame:
    return of_results(spark, sf, X.strip_latex)


@query(f"with {RESULTS} select result_id, regexp_replace(answer, '\\\\text\\{{([^}}]*)\\}}', '\\1', 'g') as answer from r")
def text_only(spark: SparkSession, sf: str) -> DataFrame:
    return of_results(spark, sf, X.text_only)


@query("select problem_id, case when prompt is null then coalesce(reference, '') else prompt || chr(10) || coalesce(reference, '') end as joined, coalesce(prompt, coalesce(reference, '')) as first from problems")
def content_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts among typed parts, joined and the first of them; a null prompt is an image here."""
    part = lambda c: F.struct(F.when(c.isNull(), "image").otherwise("text").alias("type"), c.alias("text"))
    parts = F.array(part(F.col("prompt")), part(F.coalesce("reference", F.lit(""))))
    return read_table(spark, sf, "problems").select("problem_id", H.text_parts(parts).alias("joined"), H.first_text(parts).alias("first"))


@query(f"with {RESULTS} select result_id, case when coalesce(error, '') <> '' then error || chr(10) || chr(10) || answer else answer end as whole, nullif(length(error), 0)::int as hidden from r")
def hidden_joined(spark: SparkSession, sf: str) -> DataFrame:
    """A hidden part (the error's text here) before the answer, with its length."""
    rows = read_table(spark, sf, "results").select("result_id", F.coalesce("answer", F.lit("")).alias("answer"), "error")
    return rows.select("result_id", H.with_hidden(F.col("error"), F.col("answer")).alias("whole"), H.hidden_length(F.col("error")).alias("hidden")).dropDuplicates(["result_id"])


@query("select gen_id, format('{:.1f}%', round(agreement_rate * 1000) / 10) as shown from generated_problems where agreement_rate is not null and abs(agreement_rate * 1000 - floor(agreement_rate * 1000) - 0.5) > 0.001")
def percent_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Rates as percent with one digit; exact halves are left out, since they round by the last bit of a double."""
    tenth = F.col("agreement_rate") * 1000
    rows = read_table(spark, sf, "generated_problems").where(F.col("agreement_rate").isNotNull() & (F.abs(tenth - F.floor(tenth) - 0.5) > 0.001))
    return rows.select("gen_id", H.percent(F.col("agreement_rate")).alias("shown"))
