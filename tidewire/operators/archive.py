"""Keyed archive: upsert with first and last sight, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import retention_time


# What sources say of an item beyond its title and address, kept once known.
META = ["aihot_score", "aihot_category", "aihot_selected", "provided_title_en", "provided_title_zh", "creator_metrics", "search_surface", "summary"]


def upsert(archive: DataFrame, batch: DataFrame, key: str, now: Column, seq: str = "ingest_seq", meta: list[str] = META) -> DataFrame:
    """Merge a run's rows into the archive by key.

    Of a run's rows with one key the last (by ``seq``) gives the values, but of the columns in ``meta`` the last non-null
    one, and a null leaves the archive's; published_at stays as it was, else is the run's first non-null one, but for
    subscription feeds the run's last non-null one wins. New keys are first seen now; all keys of the run are last seen
    now.
    """
    values = [c for c in batch.columns if c not in (key, seq, "published_at")]
    one = batch.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)) if c in meta else F.col(seq)).alias(f"_{c}") for c in values],
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), F.col(seq))).alias("_first_pub"),
        F.max_by("published_at", F.when(F.col("published_at").isNotNull(), F.col(seq))).alias("_last_pub"),
        F.lit(True).alias("_new"),
    )
    both = archive.join(one, key, "full_outer")
    site = F.coalesce("_site_id", "site_id")
    published = F.when(site == "opmlrss", F.coalesce("_last_pub", "published_at")).otherwise(F.coalesce("published_at", "_first_pub"))
    return both.select(key, *[(F.coalesce(f"_{c}", c) if c in meta else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))).alias(c) for c in values], published.alias("published_at"), F.coalesce("first_seen_at", F.when(F.col("_new"), now)).alias("first_seen_at"), F.when(F.col("_new"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def prune(archive: DataFrame, now: Column, days: int) -> DataFrame:
    at = retention_time(F.col("last_seen_at"), F.col("published_at"), F.col("first_seen_at"), now)
    return archive.where(at >= now - F.make_dt_interval(days=F.lit(days)))
