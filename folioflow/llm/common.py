"""Shared plumbing: scratch tables in the cluster's shared folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper bound, in bytes of column data, of one piece of a batch handed to an operator's Python code.
PIECE_BYTES = 4 << 20

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master where that is unset, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="shared-")
    return _fallback[app]


class Scratch:
    """Tables written once to the shared folder, so that lineage is cut and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return the written table."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def forget(self, df: DataFrame) -> None:
        """Delete a table that keep() returned and that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes; a longer row stands alone."""
    rows = batch.num_rows
    if rows == 0:
        return
    if batch.nbytes <= limit:
        yield batch
        return
    step = max(1, int(rows * limit / batch.nbytes))
    for start in range(0, rows, step):
        part = batch.slice(start, min(step, rows - start))
        if part.num_rows > 1 and part.nbytes > 2 * limit:
            half = part.num_rows // 2
            yield from pieces(part.slice(0, half), limit)
            yield from pieces(part.slice(half), limit)
        else:
            yield part


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow over bounded pieces; make() runs once in each task and returns the function for a piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in pieces(batch):
                yield from each(part)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer's file.

    Fixed values: printable bytes stand for themselves, the others, in order, are the letters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(other)}


def lower_table(delimiters: Iterable[int] = ()) -> bytes:
    """A bytes.translate table: A-Z to a-z, the delimiters to a space."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in delimiters:
        table[c] = 32
    return bytes(table)
