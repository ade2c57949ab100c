"""A data source of stored payloads: ``spark.read.format("tidewire_payloads")``.

Payload files lie at ``<path>/source=<id>/day=<yyyy-mm-dd>/<file>``, one file for each answer of a source. The reader plans
its partitions from the catalogue of sources and the files there are: filters on ``source`` and ``day`` choose folders, so
that other files aren't even listed. Each file is a row, whatever is wrong with it: a file that can't be read, is too
large or empty has a null payload and says so in ``error``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "tidewire_payloads"
SCHEMA = "source string, day date, file string, bytes long, payload string, error string"
#: Files of a partition hold about so many bytes together; a larger file is a row with an error.
PARTITION_BYTES, MAX_BYTES = 64 << 20, 256 << 20
ROWS = pa.schema([("source", pa.string()), ("day", pa.date32()), ("file", pa.string()), ("bytes", pa.int64()), ("payload", pa.string()), ("error", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def decoded(data: bytes) -> str:
    """Bytes of a payload as text: UTF-8, or GB18030 where that leaves fewer characters unread."""
    texts = [data.decode(encoding, errors="replace") for encoding in ("utf-8", "gb18030")]
    return min(texts, key=lambda t: t.count("�"))


@dataclass
class Files(InputPartition):
    """(source, day, path, size) of the files that one task reads."""

    files: list[tuple[str, dt.date | None, str, int]]


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError(f"{NAME} needs a path")
        self.path, self.most = options["path"], int(options.get("maxBytes", MAX_BYTES))
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.known = [s for s in options.get("sources", "").split(",") if s] or None
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what names sources or bounds days; the rest goes back to Spark."""
        order = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in ("source", "day") and type(f) in order:
                self.tests.append((column, lambda x, f=f, test=order[type(f)]: x is not None and test(x, f.value)))
            elif column in ("source", "day") and isinstance(f, In):
                self.tests.append((column, lambda x, f=f: x in f.value))
            elif column in ("source", "day") and isinstance(f, IsNotNull):
                continue  # folders name both
            else:
                yield f

    def _fits(self, column: str, value) -> bool:
        return all(test(value) for name, test in self.tests if name == column)

    def partitions(self) -> list[Files]:
        """Files of the wanted sources and days, packed by size; a source's folder is listed only if it is wanted."""
        system, root = opened(self.path)
        # A folder that is missing altogether is the caller's mistake, and fails.
        folders = [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name.startswith("source=")]
        wanted = sorted((f.base_name.removeprefix("source="), f.path) for f in folders)
        parts, held, size = [], [], 0
        for source, path in wanted:
            if not self._fits("source", source) or (self.known and source not in self.known):
                continue
            for day_folder in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
                said = day_folder.base_name.removeprefix("day=")
                try:
                    day = dt.date.fromisoformat(said)
                except ValueError:
                    continue
                if not self._fits("day", day):
                    continue
                for f in sorted(system.get_file_info(fs.FileSelector(day_folder.path)), key=lambda f: f.path):
                    if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
                        continue
                    if held and size + f.size > self.size:
                        parts.append(Files(held))
                        held, size = [], 0
                    held.append((source, day, f.path, f.size))
                    size += f.size
        return [*parts, Files(held)] if held else parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for source, day, path, size in partition.files:
            text, error = None, None
            if size > self.most:
                error = "too large"
            else:
                try:
                    with system.open_input_stream(path) as f:
                        text = decoded(f.read())
                    error = None if text.strip() else "empty"
                except OSError as failed:
                    text, error = None, type(failed).__name__
            row = {"source": source, "day": day, "file": path.rsplit("/", 1)[-1], "bytes": size, "payload": text if error is None else None, "error": error}
            yield pa.RecordBatch.from_pylist([row], schema=ROWS)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options)


def stored_payloads(spark: SparkSession, path: str, sources: list[str] | None = None, **options) -> DataFrame:
    """(source, day, file, bytes, payload, error) of the payload files below ``path``, of the catalogue's ``sources``."""
    spark.dataSource.register(PayloadSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("path", path)
    if sources:
        reader = reader.option("sources", ",".join(sources))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def source_statuses(payloads: DataFrame, items: DataFrame) -> DataFrame:
    """(source, payloads, failed, errors, items): one status row a source; ``items`` has the source of each item.

    A broken payload counts as failed and doesn't stop its source or others.
    """
    from pyspark.sql import functions as F

    held = payloads.groupBy("source").agg(F.count("*").alias("payloads"), F.count("error").alias("failed"), F.array_sort(F.collect_set("error")).alias("errors"))
    counts = items.groupBy("source").agg(F.count("*").alias("items"))
    return held.join(counts, "source", "left").select("source", "payloads", "failed", "errors", F.coalesce("items", F.lit(0)).alias("items"))
