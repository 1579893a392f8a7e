"""Duplicates hidden by formatting: an incremental, bucketed ledger of canonical keys that outlives its session."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions.canon import answer_content, canonical_answer, canonical_text, let
from rolloom.operators.skew import lookup
from rolloom.session import Store, cut, release, temporary

#: Keys a bucket holds on average, at most; with more keys the number of buckets doubles.
PER_BUCKET = 2_000_000


def record_key(*parts: Column) -> Column:
    """128-bit key of canonical parts; the parts' ends are kept apart."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts])))


class Ledger:
    """Counts of canonical keys that grow batch by batch, in a folder that all executors share.

    The folder holds numbered manifests (the last counts), tables of counts (key, n, first_id) and tables of members (key, rec_id), all partitioned by bucket, a
    hash of the key. A batch's new members are those whose bucket doesn't hold them yet, so a record delivered again, in the same batch or later, counts once. They are aggregated (with
    partial sums before the shuffle), full-outer-joined with the counts of the buckets they touch, and the merged buckets are written anew;
    other buckets are taken over as they are. The state changes when the next manifest appears: a run that breaks off before leaves nothing but folders that the next
    opening removes, and a batch named in the manifest is not counted again. Of two writers at once one fails. The number of buckets
    follows the number of keys, and a bucket is written by as many tasks as there are shuffle partitions for it.
    """

    COUNTS, MEMBERS = "key binary, n bigint, first_id bigint, bucket int", "key binary, rec_id bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, per_bucket: int = PER_BUCKET):
        self.spark, self.path, self.per_bucket, self.store = spark, path, per_bucket, Store(spark)
        found = [n for n in self.store.names(path) if n.startswith("manifest-") and n.endswith(".json")]
        self.state = json.loads(self.store.read(f"{path}/{found[-1]}")) if found else {"number": 0, "buckets": 1, "keys": 0, "counts": [], "members": [], "batches": []}
        self._sweep()

    def _sweep(self) -> None:
        """Remove what the manifest doesn't name."""
        held = {name for name, _ in self.state["counts"] + self.state["members"]} | {self._manifest(self.state["number"])}
        for name in self.store.names(self.path):
            if name not in held:
                self.store.delete(f"{self.path}/{name}")

    @staticmethod
    def _manifest(number: int) -> str:
        return f"manifest-{number:09d}.json"

    def _read(self, kind: str, schema: str, only: list[int] | None) -> DataFrame:
        tables = []
        for name, held in self.state[kind]:
            take = [b for b in held if only is None or b in only]
            if take:
                tables.append(self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(take)))
        return functools.reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], schema)

    def counts(self, only: list[int] | None = None) -> DataFrame:
        """(key, n, first_id, bucket), of some buckets or of all; each key once."""
        return self._read("counts", self.COUNTS, only)

    def members(self, only: list[int] | None = None) -> DataFrame:
        """(key, rec_id, bucket) of the records counted."""
        return self._read("members", self.MEMBERS, only)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, by: str, buckets: int) -> str:
        """A new table of the folder; several tasks write a bucket, and one task only few buckets."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        name = f"{kind}-{uuid.uuid4().hex}"
        df.repartition(tasks, "bucket", F.pmod(F.hash(by), F.lit(max(tasks // buckets, 1)))).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def add(self, batch: DataFrame, key: str, rec_id: str, name: str) -> bool:
        """Count the batch `name` in; False if that has been done before. Rows with a null key are left out."""
        if name in self.state["batches"]:
            return False
        old = self.state
        rows = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(rec_id).alias("rec_id")).distinct()
        touched, held = list(range(old["buckets"])), None
        if old["counts"]:
            held = rows = cut(rows, "batch")
            touched = sorted(r[0] for r in rows.select(self._bucket(old["buckets"])).distinct().collect())  # at most as many numbers as buckets
            rows = rows.join(self.members(touched).drop("bucket"), ["key", "rec_id"], "left_anti")
        fresh = self._write(rows.withColumn("bucket", self._bucket(old["buckets"])), "members", "rec_id", old["buckets"])
        new = self.spark.read.schema(self.MEMBERS).parquet(f"{self.path}/{fresh}").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_id"))
        if old["counts"]:
            a, b = self.counts(touched).alias("a"), new.alias("b")
            new = a.join(b, "key", "full_outer").select("key", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), F.least("a.first_id", "b.first_id").alias("first_id"))
        merged = self._write(new.withColumn("bucket", self._bucket(old["buckets"])), "counts", "key", old["buckets"])
        kept = [[n, [b for b in held if b not in touched]] for n, held in old["counts"]]
        state = old | {"number": old["number"] + 1, "batches": [*old["batches"], name], "members": [*old["members"], [fresh, touched]], "counts": [[n, held] for n, held in kept if held] + [[merged, touched]]}
        state["keys"] = self._with(state).counts().count()
        self._replace(self._grown(state))
        if held is not None:
            release(held)
        return True

    def _with(self, state: dict) -> Ledger:
        """The ledger in another state."""
        other = object.__new__(Ledger)
        other.__dict__ = self.__dict__ | {"state": state}
        return other

    def _grown(self, state: dict) -> dict:
        """The state with as many buckets as its keys need; all of it is written anew when that number doubles."""
        buckets = state["buckets"]
        while state["keys"] > buckets * self.per_bucket:
            buckets *= 2
        if buckets == state["buckets"]:
            return state
        at = self._with(state)
        everything = list(range(buckets))
        tables = {kind: [[self._write(df.withColumn("bucket", self._bucket(buckets)), kind, by, buckets), everything]] for kind, df, by in (("counts", at.counts(), "key"), ("members", at.members(), "rec_id"))}
        return state | {"buckets": buckets} | tables

    def _replace(self, state: dict) -> None:
        self.store.write(f"{self.path}/{self._manifest(state['number'])}", json.dumps(state), replace=False)
        self.state = state
        self._sweep()


def by_arrival(records: DataFrame, at: str, batches: int) -> Iterable[DataFrame]:
    """The records in batches by the time `at`, in order; null times come in the first. Bounds are approximate quantiles."""
    time = F.unix_micros(F.col(at).cast("timestamp"))
    bounds = sorted(set(records.agg(F.percentile_approx(time, [(i + 1) / batches for i in range(batches - 1)], 1000)).head()[0] or []))
    for low, high in zip([None, *bounds], [*bounds, None]):
        after = F.lit(True) if low is None else time > low
        until = F.lit(True) if high is None else time <= high
        yield records.where((after & until) | time.isNull() if low is None else after & until)


def answer_records(results: DataFrame) -> DataFrame:
    """(rec_id, key) of the non-empty answers of `results`: the same run and the same canonical answer share a key.

    Null, blank and placeholder answers are no records. A redelivered row has the same rec_id and key; the ledger counts it once.
    """
    keys = let(answer_content(F.col("answer")), lambda canon: F.when(canon.isNotNull(), F.array(record_key(F.lit("answer"), F.col("run_id"), canon))))
    # exploded, since a filter would be pushed below and have the key computed twice
    return results.select(F.col("result_id").alias("rec_id"), F.explode(keys).alias("key"))


def problem_records(generated: DataFrame) -> DataFrame:
    """(rec_id, key) of generated problems: canonical problem with the multiset of canonical answers.

    Null and blank entries of all_answers are entries, all alike; a null list differs from an empty one. A null or blank problem is a
    record like others: its key holds the empty text.
    """
    entries = F.array_sort(F.transform("all_answers", lambda a: F.coalesce(canonical_answer(a), F.lit(""))))
    key = record_key(F.lit("problem"), F.coalesce(canonical_text(F.col("problem")), F.lit("")), F.array_join(entries, "\u0002"), F.size(F.col("all_answers")))
    return generated.select(F.col("gen_id").alias("rec_id"), F.explode(F.array(key)).alias("key"))


def build(rows: DataFrame, at: str, records: Callable[[DataFrame], DataFrame], batches: int = 3, path: str | None = None) -> Ledger:
    """The ledger into which the `records` of rows are counted, batch by batch of arrival (`at`); each row is read for its batch only. Without a path it is removed at the end of the driver."""
    ledger = Ledger(rows.sparkSession, path or temporary(rows.sparkSession, "ledger"))
    for i, batch in enumerate(by_arrival(rows, at, batches)):
        ledger.add(records(batch), "key", "rec_id", f"arrival-{i}")
    return ledger


def copies(ledger: Ledger) -> DataFrame:
    """(first_id, copy_id): every record that repeats an earlier one, by the ledger's counts."""
    repeated = ledger.counts().where("n > 1").select("key", "first_id", "n")
    return lookup(ledger.members().select("key", F.col("rec_id").alias("copy_id")), "key", repeated, "n").where("copy_id <> first_id").select("first_id", "copy_id")


def collapsed(ledger: Ledger) -> DataFrame:
    """(first_id, copies): each distinct record once, with its number of copies."""
    return ledger.counts().select("first_id", F.col("n").alias("copies"))
