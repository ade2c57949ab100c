"""Archive files of two shapes and single-document exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<id: string, site_id: string, title: string, url: string, published_at: string, first_seen_at: string, last_seen_at: string>"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives that are {items: [...]}, {id: record, ...} or [...]; broken documents give no rows."""
    doc = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"struct<items: array<{RECORD}>>")["items"]
    mapped = F.map_values(F.from_json("value", f"map<string, {RECORD}>"))
    listed = F.from_json("value", f"array<{RECORD}>")
    usable = lambda a: F.when(F.exists(a, lambda r: r["id"].isNotNull()), a)
    return doc.select(F.explode(F.coalesce(usable(items), usable(listed), usable(mapped))).alias("r")).select("r.*").where("id is not null")


def export_document(df: DataFrame, path: str) -> None:
    """One JSON line for each row; the parts in order form the document's item list, whatever its size."""
    df.write.mode("overwrite").json(path)


def read_title_cache(spark: SparkSession, path: str) -> DataFrame:
    """(title, title_zh) of a cache document {title: translation}; a broken document, and blank pairs, give no rows."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("title", "title_zh"))
    return pairs.where("trim(title) != '' and trim(title_zh) != ''")


STATE = "struct<last_run_at: timestamp, last_ok: boolean, last_item_count: long, last_success_at: timestamp, last_error: string>"


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """The run state of metered sources from its document {sources: {name: entry}}; a broken one gives no rows."""
    doc = F.from_json("value", f"struct<sources: map<string, {STATE}>>")
    return spark.read.text(path, wholetext=True).select(F.explode(doc["sources"]).alias("source", "e")).select("source", "e.*")


def read_view(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """The rows of a published document, from the list it has under the name ``rows``; ``schema``: a row's struct."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"struct<{rows}: array<{schema}>>")[rows]).alias("r")).select("r.*")
