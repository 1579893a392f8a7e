"""Queries of this subpackage's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm import crosssplit, leakage, ledger, nearpivot, pairs, subjects, tokenizer, truncation
from rolloom.llm.replies import Replies, all_replies
from rolloom.session import read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.overlap_pairs(read_table(spark, sf, "problems"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.overlap_report(read_table(spark, sf, "problems"))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return nearpivot.near_groups(nearpivot.problem_texts(read_table(spark, sf, "problems"), read_table(spark, sf, "generated_problems")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearpivot.pairs_of_groups(_near(spark, sf))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each record with words: its group."""
    return _near(spark, sf)


def _ledgers(spark: SparkSession, sf: str) -> list[tuple[str, ledger.Ledger]]:
    return [("results", ledger.build(read_table(spark, sf, "results"), "received_at", ledger.answer_records)), ("generated_problems", ledger.build(read_table(spark, sf, "generated_problems"), "ingested_at", ledger.problem_records))]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [ledger.copies(book).select(F.lit(tbl).alias("tbl"), "first_id", "copy_id") for tbl, book in _ledgers(spark, sf)]
    return parts[0].unionByName(parts[1])


def p5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct record once, with its number of copies."""
    parts = [ledger.collapsed(book).select(F.lit(tbl).alias("tbl"), "first_id", "copies") for tbl, book in _ledgers(spark, sf)]
    return parts[0].unionByName(parts[1])


def _replies(spark: SparkSession, sf: str) -> Replies:
    return all_replies(*(read_table(spark, sf, t) for t in ("results", "infer_runs", "samples")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_replies(_replies(spark, sf))


def p2_share(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_share(_replies(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.faulty_pairs(_replies(spark, sf))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defect_report(_replies(spark, sf))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_table(read_table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.passages(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(*(read_table(spark, sf, t) for t in ("documents", "subjects", "subject_labels")))


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(*(read_table(spark, sf, t) for t in ("documents", "subjects", "subject_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_share, p3_found, p3_groups, p4_found, p4_report, p5_collapsed, p5_found, p6_ids, p7_found, p7_items, p7_passages, p8_composition, p8_found)}
#: SQL can express none of them: tests compare with brute force, exact round trips and known truth.
SQL: dict[str, str] = {}
