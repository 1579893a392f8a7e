"""Documents of runs and evaluations, as rows: one row a run, with its samples in order, its progress and its summary.

A document holds the samples of one run, which fit a row by their nature. `sinks.write_documents` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.rewards import check_correct
from rolloom.operators.consistency import answer_counts


def in_order(rows: DataFrame, index: str = "sample_idx", *then: str) -> DataFrame:
    """Rows by their sample index, a missing one as 0."""
    return rows.orderBy(F.coalesce(index, F.lit(0)), *then)


def extended(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def ordered_array(fields: list[str], index: str = "sample_idx") -> Column:
    """The rows of a group as one array of structs by their index, a missing one as 0; rows with the same index by their fields."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(index, F.lit(0)).alias("at"), F.struct(*fields).alias("row")))), lambda x: x["row"])


def summaries(results: DataFrame, by: list[str], order: str, answer: str = "answer") -> DataFrame:
    """(by, majority_answer, majority_votes, n_answered, answer_distribution) over the answers that aren't empty. The distribution maps answers to counts, most frequent first, then first seen."""
    counts = answer_counts(results.where(F.col(answer) != ""), by, answer, order)
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("first_at").alias("f"), F.col(answer).alias("a"))))
    placed = counts.groupBy(*by).agg(entries.alias("e"), F.sum("n").alias("n_answered"))
    distribution = F.map_from_entries(F.transform("e", lambda x: F.struct(x["a"].alias("key"), (-x["k"]).alias("value"))))
    return placed.select(*by, F.element_at("e", 1)["a"].alias("majority_answer"), (-F.element_at("e", 1)["k"]).alias("majority_votes"), "n_answered", distribution.alias("answer_distribution"))


def run_summaries(results: DataFrame, runs: DataFrame, order: str = "result_id", run: str = "run_id") -> DataFrame:
    """(run, majority_answer, agreement_rate, n_valid_answers, n_empty, answer_distribution) of inference runs; n_empty counts from the run's n_samples. A run without an answer has no summary."""
    s = summaries(results, [run], order).join(runs.select(run, "n_samples"), run)
    return s.select(run, "majority_answer", F.round(F.col("majority_votes") / F.col("n_answered"), 3).alias("agreement_rate"), F.col("n_answered").alias("n_valid_answers"), (F.col("n_samples") - F.col("n_answered")).alias("n_empty"), "answer_distribution")


def run_documents(runs: DataFrame, results: DataFrame, fields: list[str], order: str = "result_id", run: str = "run_id") -> DataFrame:
    """The runs' own columns with `results` (their samples in order) and `summary`, null where no sample has an answer. A run without samples has an empty array."""
    summary = run_summaries(results, runs, order, run)
    inner = [c for c in summary.columns if c != run]
    samples = results.groupBy(run).agg(ordered_array(fields).alias("results"))
    packed = summary.select(run, F.struct(*inner).alias("summary"))
    joined = runs.join(samples, run, "left").join(packed, run, "left")
    return joined.withColumn("results", F.coalesce("results", F.array().cast(samples.schema["results"].dataType)))


def repeat_progress(results: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, done, total, n_correct, n_answered, n_errors, accuracy) of repeated evaluations of one problem: `runs` has run, n_samples and reference. Accuracy is over answered samples, in
    percent with two digits, 0 without one; without a reference nothing is correct."""
    answered = F.col("answer") != ""
    right = answered & (F.col("answer") == F.col("reference")) & (F.col("reference") != "")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    sums = results.join(runs.select(run, "reference"), run).groupBy(run).agg(F.count(F.lit(1)).alias("done"), count(right).alias("n_correct"), count(answered).alias("n_answered"), count(F.col("error") != "").alias("n_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    accuracy = F.when(F.col("n_answered") > 0, F.round(100.0 * F.col("n_correct") / F.col("n_answered"), 2)).otherwise(0.0)
    return runs.join(sums, run, "left").select(run, zero("done"), F.col("n_samples").alias("total"), zero("n_correct"), zero("n_answered"), zero("n_errors"), F.coalesce(accuracy, F.lit(0.0)).alias("accuracy"))


def repeat_documents(runs: DataFrame, results: DataFrame, fields: list[str], order: str = "result_id", run: str = "run_id") -> DataFrame:
    """The runs' own columns with `results` in order, `progress`, `completed` (all samples done), and, when completed, `summary` with the distribution of answers."""
    progress = repeat_progress(results, runs, run)
    best = summaries(results, [run], order).select(run, "majority_answer", "answer_distribution")
    samples = results.groupBy(run).agg(ordered_array(fields).alias("results"))
    joined = runs.join(samples, run, "left").join(progress, run).join(best, run, "left").withColumn("completed", F.col("done") >= F.col("total"))
    tally = F.struct("done", "total", "n_correct", "n_answered", "accuracy").alias("progress")
    summary = F.when(F.col("completed"), F.struct("reference", "n_samples", "n_answered", "n_errors", "n_correct", "accuracy", "answer_distribution", "majority_answer")).alias("summary")
    return joined.select(*runs.columns, "results", "completed", tally, summary)


def reaction_results(problems: DataFrame, samples: DataFrame, key: str = "problem_idx") -> DataFrame:
    """(problem columns, n_correct, n_samples, accuracy, samples): each problem with its answers in order, compared as molecules. An empty answer is wrong, a problem without answers counts none.

    `problems` has key and reference; `samples` has key, sample_idx, answer and elapsed_s.
    """
    joined = samples.join(problems.select(key, "reference"), key).withColumn("correct", check_correct(F.coalesce("answer", F.lit("")), F.col("reference")))
    each = joined.groupBy(key).agg(F.sum(F.col("correct").cast("int")).alias("n_correct"), F.count(F.lit(1)).alias("n_samples"), ordered_array(["answer", "correct", "elapsed_s"]).alias("samples"))
    kinds = each.schema["samples"].dataType
    full = problems.join(each, key, "left").withColumns({"n_correct": F.coalesce("n_correct", F.lit(0)), "n_samples": F.coalesce("n_samples", F.lit(0)), "samples": F.coalesce("samples", F.array().cast(kinds))})
    return full.withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_samples"), F.lit(0.0)))


def reaction_report(results: DataFrame, by: str) -> DataFrame:
    """(by, problems, any_correct, all_correct, n_correct, n_samples), with the totals under a null name, sorted by name. A null name is "(none)"."""
    named = results.withColumn("_name", F.coalesce(by, F.lit("(none)")))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    report = named.rollup("_name").agg(
        F.count(F.lit(1)).alias("problems"), count(F.col("n_correct") > 0).alias("any_correct"), count((F.col("n_correct") == F.col("n_samples")) & (F.col("n_samples") > 0)).alias("all_correct"),
        F.sum("n_correct").alias("n_correct"), F.sum("n_samples").alias("n_samples"),
    )
    return report.withColumnRenamed("_name", by).orderBy(F.asc_nulls_last(by))


__all__ = ["in_order", "extended", "summaries", "run_summaries", "run_documents", "repeat_progress", "repeat_documents", "reaction_results", "reaction_report"]
