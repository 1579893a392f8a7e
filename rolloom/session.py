"""Session helpers: table access, and durable cuts of the lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by `spark.checkpoint.dir`.

    Where the setting is absent, a local master gets a temporary folder of its own; a cluster is an error,
    because a folder of one machine would not outlive that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    held = getattr(spark, "_rolloom_dir", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="rolloom-")
        spark._rolloom_dir = held
    return held


class Store:
    """Small files and folders of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway, self._conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        where, fs = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = True) -> None:
        """A whole file at once: written beside its place, then renamed. Without `replace` an existing file is an error."""
        self.write_parts(path, [text], replace)

    def write_parts(self, path: str, parts: Iterable[str], replace: bool = True) -> None:
        """The same for a text that comes in parts."""
        part, fs = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, True)
        try:
            for text in parts:
                stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.move(str(part), path, replace)

    def move(self, source: str, target: str, replace: bool = True) -> None:
        """Rename a file, over an existing one unless that is to be an error."""
        a, fs = self._at(source)
        b, _ = self._at(target)
        fs.mkdirs(b.getParent())
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = next(o for o in rename if str(o) == ("OVERWRITE" if replace else "NONE"))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(a), fs.makeQualified(b), options)

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        Store(spark).delete(path)
    except Exception:  # the session may be gone already
        pass


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/rolloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: later stages don't depend on any executor.

    The table is removed by `release`, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rolloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables written by `cut` whose successors are written too. Nothing that is still to be computed may read them."""
    for df in tables:
        _drop(df.sparkSession, df._rolloom_path)
