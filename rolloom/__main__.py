"""Commands: python -m rolloom COMMAND ... (or spark-submit with this file)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators import consistency, documents
from rolloom.sources import loaders, sinks


def compile_problems(spark: SparkSession, a: argparse.Namespace) -> None:
    """Kept problems of all runs, each once, as one document or JSON lines."""
    sinks.write_compiled(consistency.compiled(loaders.explode_problems(loaders.read_runs(spark, a.runs))), a.out)


def totals(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Problems of each run and of all."""
    return consistency.run_totals(loaders.read_runs(spark, a.runs, a.name), "run", "n_problems").orderBy(F.asc_nulls_last("run"))


def repeat(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Accuracy and votes of repeated evaluations, one line for each document of results."""
    results = loaders.read_results(spark, a.results).withColumn("run_id", F.col("path")).withColumn("answer", F.coalesce("answer", F.lit("")))
    runs = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_samples")).withColumn("reference", F.lit(a.reference))
    return documents.repeat_progress(results, runs).join(documents.summaries(results, ["run_id"], "sample_idx").drop("n_answered"), "run_id", "left").orderBy("run_id")


def reactions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Reaction problems against answers, by reaction type; the results of all problems are written as one document when a place is named."""
    problems = spark.read.json(a.problems).withColumn("problem_idx", F.col(a.key))
    answers = spark.read.json(a.answers).withColumn("problem_idx", F.col(a.key))
    results = documents.reaction_results(problems, answers.select("problem_idx", "sample_idx", "answer", "elapsed_s"))
    if a.out:
        sinks.write_array(results, a.out, "problem_idx")
    return documents.reaction_report(results, a.by)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rolloom", description="Rollout analytics on Spark.")
    add = top.add_subparsers(dest="command", required=True).add_parser
    p = add("compile", help=compile_problems.__doc__)
    p.set_defaults(run=compile_problems)
    p.add_argument("runs", help="folder of runs")
    p.add_argument("out", help="document (.json) or folder")
    p = add("totals", help=totals.__doc__)
    p.set_defaults(run=totals)
    p.add_argument("runs", help="folder of runs")
    p.add_argument("--name", default="keeps.json")
    p = add("repeat", help=repeat.__doc__)
    p.set_defaults(run=repeat)
    p.add_argument("results", help="pattern of result documents")
    p.add_argument("--reference", default="")
    p = add("reactions", help=reactions.__doc__)
    p.set_defaults(run=reactions)
    p.add_argument("problems", help="JSON lines with reference and a key")
    p.add_argument("answers", help="JSON lines with the key, sample_idx, answer and elapsed_s")
    p.add_argument("--key", default="id")
    p.add_argument("--by", default="reaction_type_name")
    p.add_argument("--out", default="")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    shown = a.run(spark or SparkSession.builder.appName(f"rolloom {a.command}").getOrCreate(), a)
    if shown is not None:
        for row in shown.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
