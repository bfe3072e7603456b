"""The folder that driver and executors share, tables written there to cut a plan, and small files on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own, and a cluster is refused: other machines would not see the files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that this process has written to cut plans.
_made: list[tuple[SparkSession, str]] = []


def clear() -> None:
    """Deletes all tables that this process has written into the shared folder; DataFrames that read them are of no use then. Runs by itself when the process ends."""
    while _made:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(*_made.pop())


atexit.register(clear)


def _at(spark: SparkSession, path: str):
    """A path's own file system, and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside path and renames it over path, in one step for whoever reads it."""
    fs, at = _at(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(staged)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context.rename(staged, at, options)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df into the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
