"""Intermediate tables in the folder that all executors share, so that what is used twice is computed once and survives lost executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master where that is unset, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _fallback.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, sources: DataFrame, build: Callable[[str], object]) -> str:
    """The folder of something that is built from source files once and found again as long as none of them changes.

    build(folder) fills a folder of its own, which gets the lasting name when it is whole; of two builders at once the first to end is kept.
    """
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    said = []
    for file in sorted(sources.inputFiles()):
        state = at(file).getFileSystem(hadoop).getFileStatus(at(file))
        said.append(f"{file} {state.getLen()} {state.getModificationTime()}")
    folder = f"{shared_folder(spark)}/{name}-{hashlib.sha256(chr(10).join(said).encode()).hexdigest()[:32]}"
    files = at(folder).getFileSystem(hadoop)
    if not files.exists(at(folder)):
        build(own := f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        if not files.exists(at(folder)) and not files.rename(at(own), at(folder)):
            return own
    return folder


#: Bytes of files that a task of costly work on texts gets.
TASK_BYTES = 8 << 20


def dealt(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df in a task for every so many bytes of its files, if there are fewer: tasks become more with the input, not longer."""
    hadoop, at = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    size = sum(at(f).getFileSystem(hadoop).getFileStatus(at(f)).getLen() for f in df.inputFiles())
    tasks = -(-size // task_bytes)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: a table of one large row group would keep the rest idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
