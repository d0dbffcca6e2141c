"""Tables in the shared folder: written once, read by later jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where the setting is missing a
    local session gets a temporary folder, and any other session an error, since executors would not see it."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="inkstone-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return f"file://{shared_dir.own}"


def _folder(spark: SparkSession):
    """This application's folder, as a Hadoop path with its file system. It goes when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inkstone/{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return path, files


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: later jobs neither compute it
    twice nor lose it with an executor. What an operator returns may rest on it, so it stays until `discard`ed, or until
    the application ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)[0].toString()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that are written and read again; it goes when the application ends."""
    return f"{_folder(spark)[0].toString()}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for table in tables:
        path, files = _folder(table.sparkSession)
        files.delete(path.suffix(table._staged_at.removeprefix(path.toString())), True)
