"""The training step on rollouts: batches, group-centred advantages, skipping, padded records, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.helpers import padded
from rolloom.session import cut

GROUP = ("step", "problem_id")


def number_rows(rows: DataFrame, by: str, name: str = "rn") -> DataFrame:
    """Rows with their place (from 1) in the order of the unique column `by`, without gathering them in one task.

    Rows are range-partitioned; each range is numbered by itself, after the number of rows in the ranges before it. Nulls come first. The ranges come from a sample, so the
    rows are written with their range once, and both the counts and the numbers are read from there.
    """
    ranged = cut(rows.repartitionByRange(F.col(by)).withColumn("_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_range").orderBy(by)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range: as many as there are shuffle partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    return ranged.withColumn("_local", F.row_number().over(local)).join(F.broadcast(before), "_range").withColumn(name, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def batches(rows: DataFrame, by: str, size: int, keep_tail: bool = False) -> DataFrame:
    """Rows with batch_idx in the order of `by`; the last, partial batch is dropped unless kept. No complete batch is an error when it is asked for."""
    numbered = number_rows(rows, by).withColumn("batch_idx", F.floor((F.col("rn") - 1) / size))
    if keep_tail:
        return numbered
    total = numbered.agg(F.count(F.lit(1))).scalar()
    return numbered.where(F.col("rn") <= F.floor(total / size) * size)


def schedule(n_rows: int, size: int, epochs: int) -> list[tuple[int, int, int, float]]:
    """(step, epoch, batch_idx, done_frac) of a whole training; fails without a complete batch."""
    n = n_rows // size
    if n == 0:
        raise ValueError(f"{n_rows} problems make no batch of {size}")
    return [(e * n + b, e, b, (e * n + b + 1) / (epochs * n)) for e in range(epochs) for b in range(n)]


def epoch_steps(batched: DataFrame, epochs: int) -> DataFrame:
    """Batched rows for each epoch, with the step's number and done_frac."""
    n = batched.agg(F.max("batch_idx") + 1).scalar()
    each = batched.withColumn("n_batches", n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    step = F.col("epoch") * F.col("n_batches") + F.col("batch_idx")
    return each.withColumn("step", step).withColumn("done_frac", (step + 1) / (F.col("n_batches") * epochs))


def checkpoint_due(step: Column, every: int, total: Column) -> Column:
    """At every `every`-th step (not the first) and at the end."""
    return ((step > 0) & (step % every == 0)) | (step == total - 1)


def advantages(rollouts: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Rollouts with advantage: reward less the mean of their group. A null reward gives a null advantage and doesn't count.

    Groups are the samples of one problem in one step: small by their nature, and an aggregate joined back rather than a window where they are not.
    """
    return rollouts.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy(*group)))


def with_signal(rollouts: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Rollouts of groups in which not all rewards are equal. Compared as minimum and maximum: sums of doubles would not be exact."""
    w = Window.partitionBy(*group)
    return rollouts.withColumn("_lo", F.min("reward").over(w)).withColumn("_hi", F.max("reward").over(w)).where("_lo <> _hi").drop("_lo", "_hi")


def step_metrics(rollouts: DataFrame, tokens: Column) -> DataFrame:
    """One row a step over all rewards, those of skipped groups too. advantage_std is the root of the mean square."""
    groups = rollouts.groupBy("step", "problem_id").agg(
        F.sum("reward").alias("s"), F.sum(F.col("reward") * F.col("reward")).alias("ss"), F.count("reward").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("reward").alias("lo"), F.max("reward").alias("hi"), F.sum(tokens).alias("tokens")
    )
    skipped = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    return groups.groupBy("step").agg(
        F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("reward_mean"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("reward_max"), F.coalesce(F.min("lo"), F.lit(0.0)).alias("reward_min"),
        F.coalesce(F.sqrt(F.greatest(F.sum(F.when(F.col("n") > 0, F.col("ss") - F.col("s") * F.col("s") / F.col("n"))), F.lit(0.0)) / F.sum("n")), F.lit(0.0)).alias("advantage_std"),
        (F.sum("tokens") / F.sum("rows")).alias("tokens_mean"), (F.sum(skipped.cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("skipped_frac"), F.sum(F.when(skipped, 0).otherwise(F.col("rows"))).alias("datums"),
    )


def datums(rollouts: DataFrame, *more: str) -> DataFrame:
    """Padded training records of rollouts (prompt_tokens, tokens, logprobs, reward) of groups with signal, with `more` of their columns."""
    return advantages(with_signal(rollouts)).withColumn("datum", padded(F.col("prompt_tokens"), F.col("tokens"), F.col("logprobs"), F.col("advantage"))).select(*GROUP, "sample_idx", *more, "datum.*")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) by fixed edges; bin 0 lies below, bins + 1 at the top edge and above; null values don't count."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
