"""A keyed archive that a stream keeps: restartable state of every item with a time to live, and its changes as a table.

The state (one value for each key, in RocksDB) lives in the checkpoint below the archive's folder, so a later run goes on
where the last one stopped and reads new files only. Each micro-batch writes what changed, not the archive: the archive is
the newest change of each key, and old changes are folded into a snapshot now and then.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.archive import META

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changes of so many micro-batches are read before they are folded into a snapshot.
FOLD_AFTER = 20


class ItemKeeper(StatefulProcessor):
    """One key's item: what ``operators.archive.upsert`` keeps of its rows, until it has not been seen for ``days``.

    Rows have the key, seen_at, ingest_seq, site_id, published_at and values, and count in the order of seen_at, then
    ingest_seq. The last one gives the values, of the columns in ``META`` the last non-null one; published_at is the first
    known one, but for subscription feeds the last. A row over ``days`` after the one before begins the item anew, so
    rows in order give the same however batches cut them; a timer at the last sight plus ``days`` ends an item that no
    row follows.
    """

    def __init__(self, item: T.StructType, days: float) -> None:
        self.item, self.days = item, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("item", self.item)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.item.fieldNames()
        at = dict(zip(names, self.held.get())) if self.held.exists() else dict.fromkeys(names)
        part, life = pd.concat(list(rows)).sort_values(["seen_at", "ingest_seq"], kind="stable"), dt.timedelta(days=self.days)
        for row in part.to_dict("records"):
            row = {k: None if pd.isna(v) else v for k, v in row.items()}
            if at["last_seen_at"] is not None and row["seen_at"] > at["last_seen_at"] + life:
                at = dict.fromkeys(names)
            for name in names:
                if name in ("published_at", "first_seen_at", "last_seen_at"):
                    continue
                if name not in META or row[name] is not None:
                    at[name] = row[name]
            late = row["published_at"] if row["site_id"] == "opmlrss" else None
            at["published_at"] = late or at["published_at"] or row["published_at"]
            seen = row["seen_at"]
            at["first_seen_at"] = min(filter(None, (at["first_seen_at"], seen)))
            at["last_seen_at"] = max(filter(None, (at["last_seen_at"], seen)))
        at = {k: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in at.items()}
        self.held.update(tuple(at[n] for n in names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = at["last_seen_at"].replace(tzinfo=dt.timezone.utc) + life
        self.handle.registerTimer(int(ends.timestamp() * 1000))
        yield self._change(key, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield self._change(key, dict.fromkeys(self.item.fieldNames()), True)

    def _change(self, key, at: dict, gone: bool) -> pd.DataFrame:
        frame = {"key": [key[0]]} | {n: pd.Series([v], dtype="datetime64[us]" if n.endswith("_at") else object) for n, v in at.items()}
        return pd.DataFrame(frame | {"gone": [gone]})


def _files(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name the folders below ``path``, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _newest(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in ("key", "_version")]
    return rows.groupBy("key").agg(F.max_by(F.struct("_version", *values), "_version").alias("r")).select("key", "r.*")


def current(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The items of the archive in ``folder``; ``schema``: of its changes."""
    snapshots = _files(spark, f"{folder}/snapshot")
    base = snapshots[-1] if snapshots else -1
    paths = [f"{folder}/changes/{n}" for n in _files(spark, f"{folder}/changes") if n > base]
    paths += [f"{folder}/snapshot/{base}"] if snapshots else []
    if not paths:
        return spark.createDataFrame([], schema).drop("gone")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_version", T.LongType())])).parquet(*paths)
    return _newest(rows).where("not gone").drop("gone", "_version")


def keep(spark: SparkSession, path: str, schema: T.StructType, prepare: Callable[[DataFrame], DataFrame], folder: str, days: float, files: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Run over all new files of the Parquet folder ``path`` and give the archive in ``folder`` after them.

    ``prepare`` makes rows of (id, seen_at timestamp, ingest_seq, site_id, published_at, values...). Items not seen for
    ``days`` before the watermark (the latest seen_at less ``late``) go, and come anew if they are seen again; rows later than the
    watermark still count. The first run over a folder fixes its number of state partitions.
    """
    rows = spark.readStream.schema(schema)
    rows = prepare((rows.option("maxFilesPerTrigger", files) if files else rows).parquet(path)).withWatermark("seen_at", late)
    times = [T.StructField(n, T.TimestampType()) for n in ("published_at", "first_seen_at", "last_seen_at")]
    item = T.StructType([f for f in rows.schema.fields if f.name not in ("id", "seen_at", "ingest_seq", "published_at")] + times)
    out = T.StructType([T.StructField("key", rows.schema["id"].dataType), *item.fields, T.StructField("gone", T.BooleanType())])
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        changes = rows.groupBy("id").transformWithStateInPandas(ItemKeeper(item, days), out, "Update", "EventTime")

        def write(batch: DataFrame, number: int) -> None:
            # A batch that is replayed writes its own folder again.
            batch.withColumn("_version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/{number}")

        changes.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(write).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    fold(spark, folder, out)
    return current(spark, folder, out).withColumnRenamed("key", "id")


def fold(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Fold many changes into one snapshot; what went is dropped there, and a snapshot replaces all up to its number."""
    snapshots, done = _files(spark, f"{folder}/snapshot"), _files(spark, f"{folder}/changes")
    base = snapshots[-1] if snapshots else -1
    fresh = [n for n in done if n > base]
    if len(fresh) > FOLD_AFTER:
        whole = current(spark, folder, schema).withColumn("gone", F.lit(False)).withColumn("_version", F.lit(fresh[-1]).cast("long"))
        whole.write.mode("overwrite").parquet(f"{folder}/snapshot/{fresh[-1]}")
        jvm = spark.sparkContext._jvm
        for name in [f"changes/{n}" for n in fresh] + [f"snapshot/{n}" for n in snapshots]:
            at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
