"""Micro-batch archive: stateful upsert with first and last sight, and de-duplication under a watermark."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import event_time
from tidewire.operators.archive import prune, upsert
from tidewire.operators.graph import checkpoint_dir


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, checkpoint: str | None) -> DataFrame:
    """Run an aggregating stream over all that is there now and give its result table.

    Each micro-batch writes the whole result as Parquet from the executors; the last one's is read back.
    """
    spark, at = stream.sparkSession, _folder(stream.sparkSession)
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{number}")
        written.append(number)

    writer = stream.writeStream.outputMode("complete").trigger(availableNow=True).foreachBatch(write)
    writer.option("checkpointLocation", checkpoint or f"{at}/state").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/{written[-1]}") if written else spark.createDataFrame([], stream.schema)


def first_last_seen(spark: SparkSession, path: str, schema, key: str, at: str) -> DataFrame:
    """(key, first_seen, last_seen, n) over all micro-batches of a Parquet folder."""
    rows = spark.readStream.schema(schema).parquet(path)
    return _drained(rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n")), None)


def windowed_counts(spark: SparkSession, path: str, schema, key: str, at: str, width: str) -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))
    return _drained(rows.withWatermark(at, "21 days").groupBy(F.window(at, width), key).agg(F.count("*").alias("n")), None)


def archived(spark: SparkSession, path: str, schema, key: str, prepare: Callable[[DataFrame], DataFrame], now, days: int, files: int | None = None) -> DataFrame:
    """The keyed archive after all micro-batches of a Parquet folder: each is merged into the archive so far (see
    ``operators.archive.upsert``) and what was last seen over ``days`` before ``now`` goes.

    ``prepare`` turns a batch into upsert's rows. Late rows are merged like others, none are dropped by a watermark; which
    of them show is the view's matter. Every batch writes one version of the archive from the executors, and a batch that
    is replayed writes its own version again from the one before, so no row counts twice.
    """
    at, done = _folder(spark), []

    def merge(batch: DataFrame, number: int) -> None:
        run = prepare(batch)
        before = [n for n in done if n < number]
        old = spark.read.parquet(f"{at}/{before[-1]}") if before else None
        if old is None:
            columns = [c for c in run.columns if c != "ingest_seq"]
            old = run.limit(0).select(*columns, *[F.lit(None).cast("timestamp").alias(c) for c in ("first_seen_at", "last_seen_at")])
        prune(upsert(old, run, key, now), now, days).write.mode("overwrite").parquet(f"{at}/{number}")
        done.append(number)

    rows = spark.readStream.schema(schema)
    rows = (rows.option("maxFilesPerTrigger", files) if files else rows).parquet(path)
    rows.writeStream.trigger(availableNow=True).foreachBatch(merge).option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return spark.read.parquet(f"{at}/{done[-1]}") if done else prepare(spark.createDataFrame([], schema))


def visible(archive: DataFrame, now, hours: int) -> DataFrame:
    """The archive's items of the last ``hours`` by event time, late ones included; subscription feeds' items never take
    their arrival for it."""
    return archive.where(event_time(F.col("site_id"), F.col("published_at"), F.col("first_seen_at")) >= now - F.make_dt_interval(hours=F.lit(hours)))
