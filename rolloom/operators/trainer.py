"""A training run as plans: problems in batches, scored rollouts, records for the update, metrics and samples written down."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloom.functions import helpers as H
from rolloom.functions.extract import chain_display
from rolloom.functions.rewards import Reward
from rolloom.operators import grpo
from rolloom.sources import sinks


@dataclass(frozen=True)
class Config:
    """Settings of a run. The defaults of sizes and rates are those of a common small run."""

    folder: str
    model: str = ""
    batch_size: int = 128
    group_size: int = 16
    learning_rate: float = 4e-5
    adapter_rank: int = 32
    max_tokens: int = 256
    temperature: float = 1.0
    save_every: int = 20
    epochs: int = 1
    system_prompt: str | None = None
    few_shot: tuple[tuple[str, str], ...] = ()
    prompt_suffix: str = ""
    sample_rows: int = 10


class MetricsLog:
    """Step metrics appended to a folder, and the samples table beside it; opened with the run's settings as its first document."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.folder, self.open = folder, True
        sinks.write_document(spark, settings, f"{folder}/settings.json")

    def log(self, metrics: DataFrame, samples: DataFrame | None = None) -> None:
        if not self.open:
            raise ValueError("the log is closed")
        sinks.append_metrics(metrics, f"{self.folder}/metrics")
        if samples is not None:
            samples.write.mode("append").json(f"{self.folder}/samples")

    def close(self) -> None:
        self.open = False


def samples_table(scored: DataFrame, rows: int, order: str = "sample_id", by: str = "step") -> DataFrame:
    """(step, prompt, response, expected, predicted, reward, correct): the first `rows` samples of each step by `order`. Ranks are formed over ids alone, and cut down before their shuffle."""
    first = scored.select(by, order).withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= rows).drop("_rank")
    return scored.join(first.distinct(), [by, order]).select(by, "prompt", "response", "expected", "predicted", "reward", "correct")


class Trainer:
    """Problems in, training records and metrics out. Updates of weights are left to the caller, who takes the records of a step."""

    def __init__(self, spark: SparkSession, config: Config, reward: Reward):
        self.config, self.reward = config, reward
        self.log = MetricsLog(spark, config.folder, asdict(config) | {"reward": reward.name})

    def prompts(self, problems: DataFrame) -> DataFrame:
        """Problems (problem_id, prompt, reference) in steps of all epochs, with their conversation and its text; the last, partial batch of an epoch is dropped."""
        steps = grpo.epoch_steps(grpo.batches(problems, "problem_id", self.config.batch_size), self.config.epochs)
        talk = H.messages(F.col("prompt"), self.config.prompt_suffix, self.config.system_prompt, list(self.config.few_shot))
        return steps.withColumn("messages", talk).withColumn("text", H.chat_text(F.col("messages"))).withColumn("save", self.save_due(F.col("step"), F.col("n_batches") * self.config.epochs))

    def save_due(self, step: Column, total: Column) -> Column:
        return grpo.checkpoint_due(step, self.config.save_every, total)

    def scored(self, rollouts: DataFrame) -> DataFrame:
        """Rollouts (response, reference, ...) with their reward."""
        return rollouts.withColumn("reward", self.reward(F.col("response"), F.col("reference")))

    def records(self, scored: DataFrame) -> DataFrame:
        """The padded records of the groups whose rewards differ; none where all are alike."""
        return grpo.datums(scored)

    def metrics(self, scored: DataFrame, tokens: Column | None = None) -> DataFrame:
        return grpo.step_metrics(scored, F.size("tokens") if tokens is None else tokens)

    def step(self, rollouts: DataFrame) -> DataFrame:
        """One or more steps: scores, logs the metrics and sample rows, and gives the records of the update."""
        scored = self.scored(rollouts)
        has = set(scored.columns)
        shown = scored.withColumn("expected", F.col("reference")).withColumn("correct", F.coalesce(F.col("reward") >= 1.0, F.lit(False)))
        if "predicted" not in has:
            shown = shown.withColumn("predicted", chain_display(F.col("response")))
        order = "sample_id" if "sample_id" in has else "sample_idx"
        self.log.log(self.metrics(scored), samples_table(shown, self.config.sample_rows, order) if "prompt" in has else None)
        return self.records(scored)
