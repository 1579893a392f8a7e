"""Writers: metrics, split datasets, documents, dual outputs. Paths may lie on any file system that Spark can reach."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.session import Store


def append_metrics(metrics: DataFrame, folder: str) -> None:
    """Step metrics appended as JSON lines."""
    metrics.write.mode("append").json(folder)


def write_document(spark: SparkSession, document: dict, path: str, ascii_only: bool = False) -> None:
    """One JSON document, replaced as a whole: written beside it, then renamed."""
    Store(spark).write(path, json.dumps(document, indent=2, ensure_ascii=ascii_only, default=str))


def write_array(rows: DataFrame, path: str, *order: str) -> None:
    """The rows in order as one JSON array document, null fields included. Rows come to the driver one partition at a time and go out as they come."""
    parts = (r[0] for r in rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=True))
    Store(rows.sparkSession).write_parts(path, _array(parts))


def _array(parts: Iterable[str]) -> Iterator[str]:
    yield "["
    for i, part in enumerate(parts):
        yield (",\n " if i else "\n ") + part
    yield "\n]\n"


def write_documents(documents: DataFrame, folder: str, name: str, run: str = "run_id") -> int:
    """Each row as the JSON document `folder`/<run>/`name`, replaced as a whole; the number of documents. They are written where the rows are: the driver sees none of them."""
    texts = documents.select(F.col(run).cast("string").alias("run"), F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value"))
    where = f"{folder.rstrip('/')}/.part"
    store = Store(documents.sparkSession)
    texts.write.mode("overwrite").partitionBy("run").option("maxRecordsPerFile", 1).text(where)
    try:
        names = [n for n in store.names(where) if n.startswith("run=")]
        for n in names:
            part = next(x for x in store.names(f"{where}/{n}") if x.startswith("part-"))
            store.move(f"{where}/{n}/{part}", f"{folder.rstrip('/')}/{n.removeprefix('run=')}/{name}")
    finally:
        store.delete(where)
    return len(names)


def write_split(scored: DataFrame, folder: str) -> None:
    """Candidates parted into kept and skipped ones, in one pass."""
    scored.write.mode("overwrite").partitionBy("kept").json(folder)


def dataset_documents(problems: DataFrame, header: list[str], order: str) -> DataFrame:
    """(header, n_problems, problems): the problems of each header as one array in order. For documents of one run, which fit a row."""
    fields = [c for c in problems.columns if c not in header]
    return problems.groupBy(*header).agg(F.count(F.lit(1)).cast("int").alias("n_problems"), F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("p")))), lambda x: x["p"]).alias("problems"))


def write_dataset(problems: DataFrame, folder: str, header: list[str], order: str) -> None:
    dataset_documents(problems, header, order).write.mode("overwrite").json(folder)


def write_compiled(compiled: DataFrame, path: str) -> None:
    """Compiled problems: one JSON array for a path that ends in .json, else JSON lines in a folder."""
    rows = compiled.select("prompt", "reference", "agreement_rate", "source_run")
    write_array(rows, path, "source_run", "prompt") if path.endswith(".json") else rows.write.mode("overwrite").json(path)


def full_name(path: str) -> str:
    """The path of the full output beside a short one: _full before .json, or at the end."""
    return re.sub(r"(\.json)?$", r"_full\1", path, count=1)


def write_dual(rows: DataFrame, folder: str, heavy: str = "raw_outputs") -> None:
    """The rows without the heavy column at `folder`, and whole at `full_name`. Each is a plan of its own: rows that are costly to compute come from a table here, and the short output doesn't read the heavy column."""
    rows.drop(heavy).write.mode("overwrite").json(folder)
    rows.write.mode("overwrite").json(full_name(folder))


def write_ordered(rows: DataFrame, folder: str, *order: str) -> None:
    """Rows that came in any order, written in order over all files."""
    rows.orderBy(*order).write.mode("overwrite").json(folder)


def report(rows: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """(line): each row by a printf template."""
    return rows.select(F.format_string(template, *columns).alias("line"))
