"""Helpers shared by the training-data operators: tables, checkpoints and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names, else (on a local master only) a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidewire-checkpoint-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch that hold about ``limit`` bytes of text each (at least one row)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


#: Folders that ``stored`` wrote inside the innermost ``temporary`` of this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Like ``saved``, as compressed Parquet below the shared checkpoint folder: for larger tables.

    The folder stays as long as results may read from it, unless a ``temporary`` around the call deletes it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = _written.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``stored`` wrote inside: write the results that read from it before that."""
    token = _written.set([])
    try:
        yield
    finally:
        written = _written.get()
        _written.reset(token)
        for path in written:
            delete_folder(spark, path)


#: Bit maps of ``may_match``: so many of 4 KB each, whatever the number of rows.
BITMAPS = 1024


def may_match(rows: DataFrame, of: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose 64-bit hash ``of`` may be among ``wanted`` (one column): no row that is there gets lost.

    A bit map of a fixed 4 MB is broadcast. With ever more wanted hashes it lets ever more other rows pass; a join
    decides about them.
    """
    bucket = lambda h: F.pmod(h, F.lit(BITMAPS))
    bit = lambda h: F.pmod(F.shiftright(h, 16), F.lit(4096 * 8)).cast("long")
    h = F.col(wanted.columns[0])
    maps = wanted.select(bucket(h).alias("_bucket"), bit(h).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = rows.withColumn("_of", of).withColumn("_bucket", bucket(F.col("_of"))).join(F.broadcast(maps), "_bucket")
    at = bit(F.col("_of"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shift = F.call_function("shiftright", byte, (at % 8).cast("int"))
    return marked.where(shift.bitwiseAND(F.lit(1)) == 1).select(*rows.columns)
