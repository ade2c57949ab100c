"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes each stage's
result as Parquet in the shared checkpoint folder, reads it back for the next one and then deletes what that read.

Every stage takes rows with nulls in any column, empty and very long texts, ties, repeated rows and empty tables; columns
besides those of documents are dropped. What each does with odd rows stands in its own docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import delete_folder, ensure_checkpoint_dir, table, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged by the bias alone, all alike; repeated rows get one verdict; a null key doesn't
    count. Without labels all scores are 0.5 and every row stays.
    """
    from tidewire.llm.quality import accepted

    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal and nearly equal lines stay where they stand first; documents that lose all their lines go.

    First is by key (null first), line and text. Null, empty and blank texts have no lines and stay; rows that repeat
    key and text are cut alike and all stay; n_chars is counted anew (0 for null).
    """
    from tidewire.llm.line_dedup import dedup_lines

    out = dedup_lines(docs.select(*COLUMNS)).where("n_lines = 0 or n_kept > 0")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the first by key (null first), text and the other columns.

    Null and blank texts are one group. Of rows that repeat one stays; a row with a null key stays if it is alone or
    first in its group.
    """
    from tidewire.llm.simhash import first_of_each

    return first_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go.

    Null and blank texts hold no item and stay; null and blank items are not searched, so an empty benchmark keeps
    every row; repeated rows share one verdict; keys are not read.
    """
    from tidewire.llm.decontaminate import clean

    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text decoded from them.

    A null text counts as empty; repeated rows and rows with a null key each have a row.
    """
    import public_tokenizers

    from tidewire.llm.bpe import encode_decode

    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Learning, fingerprints and token ids are not expressible in SQL; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    at = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with temporary(spark):  # other queries' tables stay
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if read:
            delete_folder(spark, read)
        read = f"{at}/{name}"
        docs = spark.read.parquet(read)
    return docs
