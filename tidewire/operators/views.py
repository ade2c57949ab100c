"""Aggregates behind the views: story records, event clusters, site statistics, one row a URL, unseen stories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.rank import first_by, votes


def story_records(items: DataFrame) -> DataFrame:
    """One row a story of items (story_id, id, name, tier_rank, ts, title, eco_group): its primary item (tier, then
    importance, where items have it, then the newest, then title), numbers of items and of distinct votes, names, first and last time. Partial aggregation only."""
    weight = F.col("importance") if "importance" in items.columns else F.lit(0.0)
    order = F.struct("tier_rank", (-weight).alias("w"), (-F.col("ts")).alias("t"), "title", "id")
    return items.groupBy("story_id").agg(F.min_by("id", order).alias("primary_id"), F.count("*").alias("item_count"), votes(F.col("eco_group"), F.col("id")).alias("duplicate_count"), F.array_sort(F.collect_set("name")).alias("names"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def event_clusters(rows: DataFrame) -> DataFrame:
    """One row an event of rows (event_key, id, signal, priority, score, ts): the primary row (priority, score, time),
    its distinct signals, rows merged, and a score with 6 for each further signal (at most 12), at most 100."""
    order = F.struct(*[(-F.col(c)).alias(c) for c in ("priority", "score", "ts")], "id")
    g = rows.groupBy("event_key").agg(F.min_by("id", order).alias("primary_id"), F.count_distinct("signal").alias("source_count"), F.count("*").alias("merged_count"), F.max("score").alias("top"))
    bonus = F.least(F.lit(12), (F.col("source_count") - 1) * 6)
    return g.select("event_key", "primary_id", "source_count", "merged_count", F.least(F.lit(100.0), F.floor(F.col("top") + bonus + 0.5)).alias("score"))


def headline_score(base: Column, sources: Column, merged: Column) -> Column:
    return F.least(F.lit(100.0), F.floor(base + F.least(F.lit(18), F.greatest(F.lit(0), sources - 1) * 9) + F.least(F.lit(8), F.greatest(F.lit(0), merged - 1) * 4) + 0.5))


def site_stats(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, raw, kept) for every site known or seen; silent sites have zeros."""
    counts = scored.groupBy("site_id").agg(F.count("*").alias("raw"), F.sum(F.col("related").cast("long")).alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sites.select("site_id").distinct().join(counts, "site_id", "full_outer").select("site_id", zero("raw"), zero("kept"))


def one_per_url(items: DataFrame, site: str, generic: Column) -> DataFrame:
    """Of one site's items (id, site_id, url_key, title, ts) with one URL: a title that isn't generic before others,
    then the newest, then the largest id. Other sites' items all stay; the site's items without URL go."""
    mine = items.where((F.col("site_id") == site) & (F.col("url_key") != ""))
    rest = [c for c in items.columns if c != "url_key"]
    best = mine.groupBy("url_key").agg(F.max_by(F.struct(*rest), F.struct(~generic, F.col("ts"), F.col("id"))).alias("r")).select("url_key", "r.*")
    return items.where(F.col("site_id").isNull() | (F.col("site_id") != site)).unionByName(best)


def unseen(stories: DataFrame, shown: DataFrame, keys: str = "identity_keys") -> DataFrame:
    """The stories none of whose identity keys (an array column of both) belongs to a story already shown."""
    taken = shown.select(F.explode(keys).alias("_key")).distinct()
    hit = stories.select("story_id", F.explode(keys).alias("_key")).join(taken, "_key", "left_semi").select("story_id").distinct()
    return stories.join(hit, "story_id", "left_anti")


def featured(rows: DataFrame, seats: int = 5, per_source: int = 2) -> DataFrame:
    """(id, seat): every row (id, site_id, badge, hot, place) with its seat, or a null seat for what follows behind the
    seats in its old order.

    In order of place, a row whose source holds ``per_source`` seats gives way if the next row of another source has the
    same badge and heat. Only a source's first ``seats`` rows can be seated, and the seats are filled before more than
    ``seats`` sources are met, so a set of that size is cut before the kernel.
    """

    def seated(part: pd.DataFrame) -> pd.DataFrame:
        ordered, first, held = part.sort_values(["place", "id"]).to_dict("records"), [], {}
        for at, row in enumerate(ordered):
            if len(first) == seats:
                break
            if held.get(row["site_id"], 0) >= per_source:
                other = next((r for r in ordered[at + 1 :] if r["site_id"] != row["site_id"]), None)
                if other is not None and (other["badge"], other["hot"]) == (row["badge"], row["hot"]):
                    continue
            first.append(row)
            held[row["site_id"]] = held.get(row["site_id"], 0) + 1
        return pd.DataFrame({"id": [r["id"] for r in first], "seat": range(1, len(first) + 1)})

    named = rows.withColumn("site_id", F.coalesce("site_id", F.lit("")))
    few = first_by(named, ["site_id"], [F.col("place"), F.col("id")], seats).orderBy("place", "id").limit(seats * (seats + 1))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "id")))  # of these few
    chosen = few.groupBy(F.lit(0).alias("all")).applyInPandas(seated, f"id {rows.schema['id'].dataType.simpleString()}, seat int")
    return rows.select("id").join(F.broadcast(chosen), "id", "left")  # at most ``seats`` rows
