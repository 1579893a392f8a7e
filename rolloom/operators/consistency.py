"""Votes over samples, agreement, and the gate for generated problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.extract import is_numeric, strip
from rolloom.operators.grpo import number_rows


def answer_counts(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """(by, answer, n, first_at): counts with the place of the first appearance. Partial sums come before the shuffle."""
    return samples.groupBy(*by, answer).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))


def majority(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """(by, majority, votes, total): the most frequent answer, among equals the one seen first. "" is an answer."""
    counts = answer_counts(samples, by, answer, order)
    rank = F.struct(F.col("n"), -F.col("first_at"))
    return counts.groupBy(*by).agg(F.max_by(answer, rank).alias("majority"), F.max("n").alias("votes"), F.sum("n").alias("total"))


def distribution(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """(by, distribution): array of (answer, n), most frequent first, then first seen. Distinct answers of one group must fit a row."""
    counts = answer_counts(samples, by, answer, order)
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("first_at").alias("f"), F.col(answer).alias("a"))))
    return counts.groupBy(*by).agg(F.transform(items, lambda x: F.struct(x["a"].alias("answer"), (-x["k"]).alias("n"))).alias("distribution"))


def ranked(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """Answer counts with their rank in each group."""
    return answer_counts(samples, by, answer, order).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("first_at"))))


def agreement_all(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """Votes of the majority over all samples; empty answers count and can win."""
    return majority(samples, by, answer, order).withColumn("agreement_rate", F.col("votes") / F.col("total"))


def agreement_valid(samples: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """Votes of the majority over non-empty answers, to three digits; with n_valid and n_empty. Without a valid answer: "" and 0."""
    rank = F.when(F.col(answer) != "", F.struct(F.col("n"), -F.col("first_at")))  # a null rank is no candidate
    counts = answer_counts(samples, by, answer, order).groupBy(*by).agg(F.max_by(answer, rank).alias("best"), F.max(F.when(F.col(answer) != "", F.col("n"))).alias("votes"), F.coalesce(F.sum(F.when(F.col(answer) != "", F.col("n"))), F.lit(0)).alias("n_valid"), F.sum("n").alias("n_samples"))
    rate = F.coalesce(F.round(F.try_divide("votes", "n_valid"), 3), F.lit(0.0))
    return counts.select(*by, F.coalesce("best", F.lit("")).alias("majority_answer"), rate.alias("agreement_rate"), "n_valid", (F.col("n_samples") - F.col("n_valid")).alias("n_empty"))


def keep_gate(rate: Column, answer: Column, gate: Column, low: float = 0.60, high: float = 0.80) -> Column:
    """In the window (both ends in), answered, and numeric by the gate's writing. Nulls don't pass."""
    return F.coalesce(rate.between(F.lit(low), F.lit(high)) & (answer != "") & is_numeric(gate), F.lit(False))


def gate_status(rate: Column, answer: Column, gate: Column, low: float = 0.60, high: float = 0.80) -> Column:
    """Why a candidate is kept or skipped: empty, then non-numeric, then KEEP, else skip."""
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", "skip (empty answer)").when(~F.coalesce(is_numeric(gate), F.lit(False)), F.concat(F.lit("skip (non-numeric: "), F.left(answer, F.lit(40)), F.lit(")")))
        .when(F.coalesce(rate.between(F.lit(low), F.lit(high)), F.lit(False)), "KEEP").otherwise("skip")
    )


def until_target(candidates: DataFrame, kept: str, order: str, target: int) -> DataFrame:
    """Candidates up to and with the one that meets the target of kept ones, in the order of the unique column `order`.

    The place of the deciding candidate is found by a top-k of the kept ones, not by a running sum over all rows.
    """
    if target <= 0:
        return candidates.where("false")
    first = candidates.where(F.col(kept)).select(order).orderBy(order).limit(target)
    last = first.agg(F.when(F.count(F.lit(1)) == target, F.max(order))).scalar()  # null while the target isn't met
    return candidates.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")


def first_wins(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each stripped text in the given order; empty and null texts are dropped. A hot text is reduced before the shuffle."""
    key = strip(F.col(text))
    return rows.where(key != "").groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")).select("_first.*")


def compiled(keeps: DataFrame) -> DataFrame:
    """(prompt, reference, agreement_rate, source_run) of exploded keeps (path, pos, problem...), the first of each problem."""
    return first_wins(keeps, "problem", ["path", "pos"]).select(strip(F.col("problem")).alias("prompt"), F.coalesce("ground_truth_answer", F.lit("")).alias("reference"), "agreement_rate", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source_run"))


def unseen(candidates: DataFrame, seen: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Candidates whose text was not seen before, the first of each text."""
    return first_wins(candidates.join(seen.select(text).distinct(), text, "left_anti"), text, order)


def run_totals(runs: DataFrame, run: str, n: str) -> DataFrame:
    """(run, n_problems) with a grand total under a null run; a missing count is 0."""
    return runs.rollup(run).agg(F.sum(F.coalesce(n, F.lit(0))).alias("n_problems"))


def random_picks(options: DataFrame, order: str, picks: int, seed: int = 0) -> DataFrame:
    """`picks` draws with replacement, each option equally likely: (pick, and the option's columns). Repeatable by seed and order."""
    numbered = number_rows(options, order)
    total = options.agg(F.count(F.lit(1))).scalar()
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("pick").cast("string"))), 1, 12), 16, 10).cast("bigint")
    drawn = options.sparkSession.range(picks).withColumnRenamed("id", "pick").withColumn("_n", total).where("_n > 0").withColumn("rn", F.pmod(number, F.col("_n")) + 1)
    return drawn.join(numbered, "rn").drop("rn", "_n")
