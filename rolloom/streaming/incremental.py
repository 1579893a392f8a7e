"""Evaluation that goes on as samples arrive, and survives a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolloom.operators.evaluate import remaining
from rolloom.session import Store


def evaluate_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Score what has arrived in micro-batches and write each to its own folder of `out`.

    A batch that is run again after a restart overwrites its own folder, so each sample is counted once. Without a `checkpoint` folder the stream keeps its place beside its
    output, in `out`_place, where a later session finds it.
    """
    where = checkpoint or f"{out.rstrip('/')}_place"
    write = lambda df, i: score(df).write.mode("overwrite").parquet(f"{out}/batch={i}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", where).trigger(availableNow=True).start()


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, n, correct, completed, accuracy) so far."""
    from rolloom.operators.evaluate import running_accuracy

    return running_accuracy(spark.read.parquet(out), "batch", F.col("correct"))


def resume(todo: DataFrame, out: str, key: str) -> DataFrame:
    """What isn't in the output yet; all where there is no output."""
    return remaining(todo, todo.sparkSession.read.parquet(out), key) if Store(todo.sparkSession).exists(out) else todo


def tail_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the appended metrics files."""
    return spark.readStream.schema("step int, reward_mean double, advantage_std double, tokens_mean double, skipped_frac double, datums bigint").json(folder)


def latest(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Redelivered rows once, for a stream: rows of a key within the time the watermark holds open."""
    return stream.withWatermark(at, "7 days").dropDuplicatesWithinWatermark([key])
