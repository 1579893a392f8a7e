"""Evaluation: accuracies, votes across models, agreement of models, run comparison, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.operators.consistency import answer_counts, ranked


def percent_correct(correct: Column) -> Column:
    """Share of correct rows in percent, two digits; 0 without rows."""
    return F.coalesce(F.round(100 * F.avg(correct.cast("double")), 2), F.lit(0.0))


def accuracy_answered(rows: DataFrame, by: list[str], answer: str, reference: str) -> DataFrame:
    """Correct over answered samples in percent; none correct where the reference is empty, 0 where nothing is answered."""
    answered = F.coalesce(F.col(answer) != "", F.lit(False))
    right = F.coalesce(answered & (F.col(answer) == F.col(reference)) & (F.col(reference) != ""), F.lit(False))
    n, k = F.sum(answered.cast("int")), F.sum(right.cast("int"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n.alias("answered"), k.alias("correct"), F.when(n > 0, F.round(100.0 * k / n, 2)).otherwise(0.0).alias("accuracy"))


def two_level_vote(samples: DataFrame, item: str, model: str, answer: str, order: str, models: list[str]) -> DataFrame:
    """(item, majority): each model's best answer by votes, then a vote over the models; ties by the order of `models`, then first seen. Empty answers don't vote."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, models)), F.col(model)), F.lit(0))
    valid = samples.where(F.coalesce(F.col(answer) != "", F.lit(False)))
    best = answer_counts(valid, [item, model], answer, order).groupBy(item, model).agg(F.max_by(answer, F.struct("n", -F.col("first_at"))).alias("best"))
    best = best.withColumn("_place", F.when(rank == 0, len(models) + 1).otherwise(rank))
    counts = best.groupBy(item, "best").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_place", model)).alias("p"))
    return counts.groupBy(item).agg(F.min_by("best", F.struct((-F.col("n")).alias("n"), "p")).alias("majority_vote"), F.max("n").alias("model_votes"))


def model_accuracy(rows: DataFrame, model: str, answer: str, reference: str) -> DataFrame:
    """(model, n, correct, accuracy) over the rows the model answered."""
    return rows.where(F.coalesce(F.col(answer) != "", F.lit(False))).groupBy(model).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(answer) == F.col(reference), F.lit(False)).cast("int")).alias("correct"), percent_correct(F.coalesce(F.col(answer) == F.col(reference), F.lit(False))).alias("accuracy")
    )


def model_agreement(best: DataFrame, item: str, model: str, answer: str) -> DataFrame:
    """(item, n_models, n_answers, verdict): agree with one answer of two models or more, disagree with several, null with one model's only."""
    each = best.where(F.col(answer).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n_models"), F.countDistinct(answer).alias("n_answers"))
    return each.withColumn("verdict", F.when(F.col("n_answers") > 1, "disagree").when(F.col("n_models") > 1, "agree"))


def any_all_rates(per_problem: DataFrame) -> DataFrame:
    """Of (n_correct, n_samples): share of problems with any and with all samples right, and of right samples. The overall accuracy is the any rate."""
    return per_problem.agg(
        F.count(F.lit(1)).alias("problems"), F.avg((F.col("n_correct") > 0).cast("double")).alias("any_rate"), F.avg((F.col("n_correct") == F.col("n_samples")).cast("double")).alias("all_rate"),
        (F.sum("n_correct") / F.sum("n_samples")).alias("sample_rate"),
    )


def pass_by_group(per_problem: DataFrame, group: str) -> DataFrame:
    return per_problem.groupBy(group).agg(F.sum((F.col("n_correct") > 0).cast("int")).alias("passed"), F.count(F.lit(1)).alias("problems"))


def running_accuracy(batched: DataFrame, batch: str, correct: Column) -> DataFrame:
    """(batch, n, n_correct, completed, accuracy): totals after each batch. Rows are summed by batch first, so the window sees one row a batch."""
    sums = batched.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("int")).alias("n_correct"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("completed", F.sum("n").over(w)).withColumn("accuracy", F.round(100 * F.sum("n_correct").over(w) / F.sum("n").over(w), 2))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def compare_counts(a: DataFrame, b: DataFrame, answer: str) -> DataFrame:
    """(answer, n_a, n_b): counts of two runs, 0 where one has none."""
    count = lambda df, n: df.groupBy(answer).agg(F.count(F.lit(1)).alias(n))
    return count(a, "n_a").join(count(b, "n_b"), answer, "full_outer").select(answer, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def top_answers(samples: DataFrame, by: list[str], answer: str, order: str, k: int = 15) -> DataFrame:
    """The k most frequent answers of each group, first seen first among equals."""
    return ranked(samples, by, answer, order).where(F.col("rank") <= k)


def pinned_order(answer: Column, total: Column, pinned: list[str]) -> list[Column]:
    """Sort keys: pinned answers first in their order, then by falling total, then by answer."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, pinned)), answer), F.lit(0)), F.lit(len(pinned) + 1))
    return [place, total.desc(), answer]


def sample_grid(problems: DataFrame, n: int, providers: list[str]) -> DataFrame:
    """Each problem for each provider and sample index."""
    return problems.withColumn("provider", F.explode(F.array(*map(F.lit, providers)))).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def checkpoints(listing: DataFrame, step: int | None = None, limit: int = 25) -> DataFrame:
    """Training checkpoints (checkpoint_type, path, time), of one step or all, latest first."""
    found = listing.where("checkpoint_type = 'training'")
    if step is not None:
        found = found.where(F.contains("path", F.format_string("ckpt-%06d", F.lit(step))))
    return found.orderBy(F.desc("time"), "path").limit(limit)
