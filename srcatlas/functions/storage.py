"""Results kept on storage that all executors can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, in local mode only, a temporary one that ends
    with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        own = tempfile.mkdtemp(prefix="srcatlas-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)  # nobody else knows of it
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(spark: SparkSession, target: str) -> str | None:
    """``target`` as a path that Python opens, on the driver and on executors; None on other file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = system.makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written out: later steps read them and do not depend on how they came.

    Not ``DataFrame.checkpoint``: that keeps the size the optimizer estimated, the product of both sides after a join, so a
    table joined with itself round by round doubles the digits of its size each time; and its rows are not compressed.
    """
    return stored(df, "step")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table into the shared folder, and read back from there."""
    target = fresh_dir(df.sparkSession, name)
    # names and paths repeat much: far smaller than with the default codec
    df.write.option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
