"""Readers of problem sets, generated datasets, run documents and settings."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom import schemas
from rolloom.functions.extract import strip
from rolloom.operators.grpo import number_rows


def _matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches; a pattern without files is no error here."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _text_of(value: Column) -> Column:
    """A JSON value as text: null as "None", booleans capitalised, other values as they are; a missing key is ""."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull(), "").when(F.is_variant_null(value), "None").when(kind == "BOOLEAN", F.initcap(value.cast("string"))).otherwise(value.cast("string"))


def _from_json_lines(lines: DataFrame, prompt_field: str, reference_field: str) -> DataFrame:
    """(at, prompt, reference, meta) of lines (at, value), each one JSON object; a faulty line fails the query when it is read."""
    row = lines.select("at", F.parse_json("value").alias("v"), F.col("value"))
    field = lambda name: F.variant_get("v", f"$['{name}']", "variant")
    rest = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(prompt_field, reference_field))
    return row.select("at", F.coalesce(F.variant_get("v", f"$['{prompt_field}']", "string"), F.lit("")).alias("prompt"), _text_of(field(reference_field)).alias("reference"), rest.alias("meta"))


def _finish(rows: DataFrame, limit: int | None) -> DataFrame:
    """Rows without a prompt dropped, then the limit (0 is none), then ids in source order."""
    rows = rows.where("prompt <> ''")
    if limit:
        rows = rows.orderBy("at").limit(limit)
    return number_rows(rows, "at", "problem_id").select("problem_id", "prompt", "reference", "meta")


def read_jsonl(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """(at, value) of a JSON-lines file, stripped; blank lines are skipped, or kept for the strict reader to fail on."""
    text = spark.read.text(path).select(F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("at"), strip(F.col("value")).alias("value"))
    return text.where("value <> ''") if skip_blank else text


def load_problems(spark: SparkSession, source: str | list[dict] | DataFrame, *, prompt_field: str = "prompt", reference_field: str = "reference", split: str = "train", limit: int | None = None, skip_blank: bool = True) -> DataFrame:
    """Problems (problem_id, prompt, reference, meta) from a list of rows, a DataFrame, or a .jsonl, .json, .csv or Parquet path.

    Suffixes count as written. A missing reference is "", a null one "None" (an explicit null of JSON, a null of a table, a field that a short CSV row lacks). Other existing files are a ValueError, another type a
    TypeError; a name that is no file stands for a hub dataset, which needs a network and is not available here.
    """
    if isinstance(source, DataFrame):
        cols = source.columns
        at = source.withColumn("at", F.monotonically_increasing_id())
        kinds = dict(source.dtypes)
        shown = lambda c: F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
        get = lambda c, null: F.coalesce(shown(c), F.lit(null)) if c in cols else F.lit("")
        rest = [x for c in cols if c not in (prompt_field, reference_field) for x in (F.lit(c), F.col(c).cast("string"))]
        return _finish(at.select("at", get(prompt_field, "").alias("prompt"), get(reference_field, "None").alias("reference"), (F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")).alias("meta")), limit)
    if isinstance(source, list):
        import json

        lines = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(source)], "at bigint, value string")
        return _finish(_from_json_lines(lines, prompt_field, reference_field), limit)
    if not isinstance(source, (str, os.PathLike)):
        raise TypeError(f"problems can't be read from {type(source).__name__}")
    path = str(source)
    if path.endswith(".jsonl"):
        return _finish(_from_json_lines(read_jsonl(spark, path, skip_blank), prompt_field, reference_field), limit)
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        if whole.where(~F.schema_of_variant("v").startswith("ARRAY")).head(1):
            raise ValueError(f"{path} holds no array")
        lines = whole.select(F.posexplode(F.col("v").cast("array<variant>")).alias("at", "v")).select("at", F.to_json("v").alias("value"))
        return _finish(_from_json_lines(lines, prompt_field, reference_field), limit)
    if path.endswith(".csv"):
        return load_problems(spark, read_csv(spark, path), prompt_field=prompt_field, reference_field=reference_field, limit=limit)
    if path.endswith(".parquet"):
        return load_problems(spark, spark.read.parquet(path), prompt_field=prompt_field, reference_field=reference_field, limit=limit)
    if _matches(spark, path):
        raise ValueError(f"no reader for {path}")
    return load_hub(path, split)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all texts; an empty field is "", only a field that a short row lacks is null."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = spark.read.options(**options, columnNameOfCorruptRecord="_short").schema(f"{kinds}, _short string").csv(path)
    # Spark reads both as null, but keeps a short row's text: its fields are counted
    held = F.size(F.split(F.regexp_replace("_short", r'"(?:[^"]|"")*"', ""), ","))
    there = lambda i: F.col("_short").isNull() | (held > i)
    return rows.select(*[F.when(there(i), F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for i, n in enumerate(names)])


def load_hub(name: str, split: str) -> DataFrame:
    raise NotImplementedError(f"hub dataset {name!r} ({split}) needs a network; read a Parquet copy of it instead")


def lookup_problem(problems: DataFrame, problem_id: int) -> DataFrame:
    """The problem of an id, the first in table order where ids repeat; LookupError without one."""
    placed = problems.withColumn("_at", F.monotonically_increasing_id())
    found = placed.where(F.col("problem_id") == problem_id).orderBy("_at").limit(1).drop("_at")
    if not found.head(1):
        raise LookupError(problem_id)
    return found


def field(key: str) -> Column:
    """prompt, reference, or an entry of meta; a missing entry is an error under ANSI mode."""
    return F.col(key) if key in ("prompt", "reference") else F.element_at("meta", key)


def read_runs(spark: SparkSession, folder: str, name: str = "keeps.json") -> DataFrame:
    """(path, run, document columns) of `folder`/*/`name`, one row a run; folders without the file are passed over, no match gives no rows."""
    pattern = f"{folder}/*/{name}"
    if not _matches(spark, pattern):
        return spark.createDataFrame([], f"path string, run string, {schemas.DATASET}")
    docs = spark.read.schema(schemas.DATASET).option("multiLine", True).json(pattern)
    return docs.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), *docs.columns)


def explode_problems(runs: DataFrame) -> DataFrame:
    """(path, run, pos, problem fields) in the documents' order."""
    return runs.select("path", "run", F.posexplode("problems").alias("pos", "p")).select("path", "run", "pos", "p.*")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One dataset document; a missing window is 0.60 to 0.80."""
    doc = spark.read.schema(schemas.DATASET).option("multiLine", True).json(path)
    return doc.withColumns({"target_agreement_low": F.coalesce("target_agreement_low", F.lit(0.60)), "target_agreement_high": F.coalesce("target_agreement_high", F.lit(0.80))})


def resume_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problems kept so far; none where the document is missing or can't be read."""
    empty = spark.createDataFrame([], schemas.GENERATED)
    if not _matches(spark, path):
        return empty
    doc = spark.read.schema(schemas.DATASET + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return doc.where("_corrupt is null and problems is not null").select(F.explode("problems").alias("p")).select("p.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run documents as rows: (path, model, problem, sample fields). No match gives no rows."""
    columns = f"path string, mode string, model string, problem string, {schemas.RESULT.replace(':', ' ').replace(',', ', ')}"
    if not _matches(spark, path):
        return spark.createDataFrame([], columns)
    docs = spark.read.schema(schemas.RUN).option("multiLine", True).json(path)
    return docs.select(F.col("_metadata.file_path").alias("path"), "mode", "model", "problem", F.explode("results").alias("r")).select("path", "mode", "model", "problem", "r.*")


def done_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Ids in an earlier output (JSON lines); none where there is no output."""
    if not _matches(spark, path):
        return spark.createDataFrame([], f"`{key}` bigint")
    return spark.read.json(path).select(F.col(key).cast("bigint").alias(key)).distinct()


def attempted_solutions(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, pos, solution) of files with arrays of texts or of objects with `reasoning`; files without an array are skipped, and the first file with a solution wins."""
    if not _matches(spark, pattern):
        return spark.createDataFrame([], "path string, pos int, solution string")
    docs = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    items = docs.select("path", F.posexplode(F.col("v").cast("array<variant>")).alias("pos", "x"))
    text = F.when(F.schema_of_variant("x") == "STRING", F.col("x").cast("string")).otherwise(F.try_variant_get("x", "$.reasoning", "string"))
    rows = items.select("path", "pos", text.alias("solution")).where("solution is not null")
    first = rows.agg(F.min("path").alias("path"))
    return rows.join(F.broadcast(first), "path")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


#: key = value, the value in quotes to the matching one, or plain up to " #".
_SETTING = re.compile(r"""\s*(?!\s|#)(?P<key>[^=]*?)\s*=\s*(?:"(?P<double>[^"]*).*|'(?P<single>[^']*).*|(?P<plain>(?:(?! \#).)*?)\s*(?: \#.*)?)""")


def read_env(text: str, existing: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of an env file's text: quoted values to the matching quote, others up to " #"; settings that exist win, and of several for one key the first."""
    found = filter(None, map(_SETTING.fullmatch, text.splitlines()))
    settings = {m["key"]: next(v for v in m.group("double", "single", "plain") if v is not None) for m in reversed(list(found))}
    return settings | (existing or {})


def first_setting(argument: str | None, variable: str | None, otherwise: str | None) -> str | None:
    """The argument if not blank, else the variable if not blank, else the looked-up value."""
    return next((x.strip() for x in (argument, variable) if x and x.strip()), otherwise)


__all__ = ["load_problems", "read_runs", "explode_problems", "load_dataset", "resume_problems", "read_results", "done_ids", "attempted_solutions", "whole_text", "read_metrics", "read_env", "first_setting", "lookup_problem", "field"]
