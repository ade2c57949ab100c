"""The reader's view queries: facets, sections, signal levels, sorts, groups, story pools and source health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import display as D
from tidewire.functions import items as I
from tidewire.operators.graph import settled
from tidewire.operators.rank import best_per_key
from tidewire.operators.scoring import NEWS, Rules, hotness, is_unsafe
from tidewire.operators.views import event_clusters, featured, headline_score

_text = lambda *names: F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names])
#: Columns that items may lack; they then count as null.
OPTIONAL = {"title_zh": "string", "title_en": "string", "title_original": "string", "title_bilingual": "string", "site_name": "string", "source": "string", "ai_label": "string", "ai_signals": "array<string>", "ai_score": "double", "score": "double", "aihot_score": "double", "source_tier": "string", "source_tier_rank": "int", "business_events": "array<string>", "published_at": "timestamp", "first_seen_at": "timestamp", "url": "string"}


@dataclass(frozen=True)
class ViewQuery:
    """What a reader asks for. mode: selected (high priority), ai, or all; section: hot or one of the sections; level:
    high, curated or multi (an event that several signals report among what the other facets leave)."""

    mode: str = "ai"
    section: str = "hot"
    site: str | None = None
    author: str | None = None
    source_type: str | None = None
    text: str = ""
    level: str | None = None
    sort: str = "priority"

    @property
    def plain(self) -> bool:
        return self.section == "hot" and not (self.site or self.author or self.source_type or self.level or self.text.strip())


UNSAFE = ("title", "title_zh", "title_en", "title_original", "source", "source_name")


def unsafe(rules: Rules = NEWS, *names: str) -> Column:
    return is_unsafe(F.lower(_text(*(names or UNSAFE))), rules)


def shown_items(items: DataFrame, now: Column, rules: Rules = NEWS) -> DataFrame:
    """Safe items (id, site_id, title and what of ``OPTIONAL`` they have) with the derived columns the views use."""
    for name, kind in OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    safe = items.where(~unsafe(rules, "title", "title_zh", "title_en", "title_original", "source"))
    content = F.lower(F.concat_ws(" ", _text("title", "title_zh", "title_en", "title_original", "source", "site_name", "site_id"), F.array_join(F.coalesce("ai_signals", F.array().cast("array<string>")), " ")))
    named = F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("site_name", F.lit(""))))
    first = safe.select("*", D.timeline(F.col("published_at"), F.col("first_seen_at"), now).alias("shown_at"), D.score_percent(F.col("ai_score"), F.col("score")).alias("percent"), D.sections(content, F.col("ai_label"), F.col("site_id"), named).alias("sections"), D.source_signal(F.col("site_name")).alias("signal"), I.source_type(F.col("site_id"), F.col("source_tier")).alias("source_type"), I.event_key(F.coalesce(F.nullif("title_zh", F.lit("")), "title")).alias("event_key"))
    age = (F.unix_micros(now) - F.unix_micros("shown_at")) / 3600e6
    rated = first.withColumn("priority", D.priority(F.col("percent"), D.editorial_percent(F.col("site_id"), F.col("aihot_score"), F.col("percent")), D.tier_percent(F.col("site_id"), F.col("source_tier_rank")), D.freshness_percent(age), F.when(F.col("ai_signals").isNotNull(), F.size("ai_signals"))))
    return rated.select("*", D.is_high(F.col("percent"), F.col("priority"), F.col("site_id")).alias("high"), D.is_curated(F.col("site_id"), F.col("source_tier")).alias("curated"))


def mode_items(shown: DataFrame, mode: str) -> DataFrame:
    """The base set of a mode; items have ai_is_related."""
    if mode == "all":
        return shown
    related = shown.where(F.coalesce("ai_is_related", F.lit(False)))
    return related.where("high") if mode == "selected" else related


def multi_source_keys(shown: DataFrame) -> DataFrame:
    return shown.groupBy("event_key").agg(F.count_distinct("signal").alias("n")).where("n > 1").select("event_key")


def filtered(shown: DataFrame, q: ViewQuery) -> DataFrame:
    """The items of a query, unsorted: mode, section, facets and text, then the signal level among what these leave."""
    out = mode_items(shown, q.mode)
    if q.section != "hot":
        out = out.where(F.array_contains("sections", q.section))
    if q.site:
        out = out.where(F.col("site_id") == q.site)
    if q.author:
        out = out.where((F.col("site_id") == "socialdata_x") & (F.col("source") == q.author))
    if q.source_type:
        out = out.where(F.col("source_type") == q.source_type)
    if q.text.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "title_zh", "title_en", "site_name", "source")]))
        out = out.where(F.contains(hay, F.lit(q.text.strip().lower())))
    if q.level in ("high", "curated"):
        return out.where(q.level)
    if q.level == "multi":
        return out.join(multi_source_keys(out), "event_key", "left_semi")
    return out


def sort_order(shown: DataFrame, sort: str) -> tuple[DataFrame, list[Column]]:
    """The items with what the sort needs, and its order; the id settles ties."""
    latest, top = F.desc_nulls_last("shown_at"), F.desc("priority")
    if sort == "latest":
        return shown, [latest, top, F.col("id")]
    if sort == "ai":
        return shown, [F.desc("percent"), top, latest, F.col("id")]
    if sort == "source":
        keyed = shown.withColumn("source_key", D.source_sort_key(F.col("site_name"), F.col("site_id"), F.col("source")))
        sizes = keyed.groupBy("source_key").agg(F.count("*").alias("group_size"))
        return keyed.join(sizes, "source_key"), [F.desc("group_size"), F.col("source_key"), top, latest, F.col("id")]
    return shown, [top, latest, F.col("id")]


def view(items: DataFrame, q: ViewQuery, now: Column, rules: Rules = NEWS) -> DataFrame:
    """The sorted list of a query."""
    rows, order = sort_order(filtered(shown_items(items, now, rules), q), q.sort)
    return rows.orderBy(*order)


def section_stats(shown: DataFrame) -> DataFrame:
    """(section, n, high, sources) of each section, hot (all items) included; every section has a row."""
    of = lambda rows: rows.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.col("high").cast("long")).alias("high"), F.count_distinct("who").alias("sources"))
    rows = shown.select("high", F.explode(F.concat(F.array(F.lit("hot")), "sections")).alias("section"), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("source", "site_name", "site_id")]).alias("who"))
    known = shown.sparkSession.createDataFrame([(s,) for s in ["hot", *D.SECTIONS]], "section string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.join(of(rows), "section", "left").select("section", zero("n"), zero("high"), zero("sources"))


def display_key(shown: DataFrame) -> Column:
    title = I.event_text(D.shown_title(*[F.col(c) for c in ("title_zh", "title", "title_en", "title_original")]))
    page = F.regexp_extract(F.coalesce("url", F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1)
    return F.when(title != "", F.concat(F.lit("title:"), title)).otherwise(F.concat(F.lit("url:"), F.coalesce(F.nullif(page, F.lit("")), F.nullif("url", F.lit("")), F.col("id").cast("string"), F.lit("untitled"))))


def source_groups(shown: DataFrame, sort: str = "priority") -> DataFrame:
    """(site_id, source, raw_count, n, value): the groups of a list, each title once (the first in the sort's order).

    ``value`` ranks the groups: the latest time, the best percentage, the size, or the mean of the three best
    priorities. The site's own row has a null source and counts its groups' items.
    """
    rows, order = sort_order(shown.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("未分割槽"))), sort)
    place = F.struct(*[(-F.col(c)).alias(c) for c in ("priority", "percent")], (-F.unix_micros(F.coalesce("shown_at", F.lit(0).cast("timestamp")))).alias("t"), "id")
    by_sort = {"latest": F.struct(place["t"], place["priority"], place["id"]), "ai": F.struct(place["percent"], place["priority"], place["t"], place["id"])}.get(sort, F.struct(place["priority"], place["t"], place["id"]))
    # Written once: the list is derived by rules and joins, and six aggregates below read it.
    keyed = settled(rows.select("site_id", "source", display_key(rows).alias("key"), "id", "priority", "percent", F.unix_micros("shown_at").alias("t"), by_sort.alias("by")))
    once = best_per_key(keyed.select("site_id", "source", "key", "id", "priority", "percent", "t", "by"), ["site_id", "source", "key"], F.col("by"))
    once = settled(once)
    raw = keyed.groupBy("site_id", "source").agg(F.count("*").alias("raw_count"))

    def rated(df: DataFrame, *keys: str) -> DataFrame:
        # The three best of a key by a ranked window, cut on the map side.
        best = df.select(*keys, "priority", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"))).alias("r")).where("r <= 3").groupBy(*keys).agg(D.half_up(F.avg("priority")).alias("lead"))
        sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max("t").cast("double").alias("latest"), F.max("percent").alias("ai"))
        value = {"latest": F.coalesce("latest", F.lit(0.0)), "ai": F.col("ai"), "source": F.col("n").cast("double")}.get(sort, F.col("lead"))
        return sums.join(best, list(keys)).select(*keys, "n", value.alias("value"))

    groups = rated(once, "site_id", "source").join(raw, ["site_id", "source"]).select("site_id", "source", "raw_count", "n", "value")
    sites = rated(once, "site_id").join(raw.groupBy("site_id").agg(F.sum("raw_count").alias("raw_count")), "site_id")
    return groups.unionByName(sites.select("site_id", F.lit(None).cast("string").alias("source"), "raw_count", "n", "value"))


def authors(items: DataFrame) -> DataFrame:
    """The authors of the social search site, sorted."""
    named = items.where((F.col("site_id") == "socialdata_x") & (F.trim("source") != ""))
    return named.select(F.trim("source").alias("author")).distinct().orderBy("author")


REF = "struct<id: string, title: string, title_zh: string, title_en: string, title_original: string, source: string, source_name: string, url: string>"


def held_refs(stories: DataFrame) -> Column:
    """The refs of a story: itself, its primary item and its items, an array."""
    names = ["id", "title", "title_zh", "title_en", "title_original", "source", "source_name", "url"]

    def ref(of: Column, fields: list[str]) -> Column:
        return F.struct(*[(of.getField(n) if n in fields else F.lit(None)).cast("string").alias(n) for n in names])

    kinds = {f.name: f.dataType for f in stories.schema.fields}
    own = F.struct(F.col("story_id").cast("string").alias("id"), F.col("title").cast("string").alias("title"), *[F.lit(None).cast("string").alias(n) for n in ("title_zh", "title_en", "title_original", "source", "source_name")], (F.col("url") if "url" in kinds else F.lit(None)).cast("string").alias("url"))
    refs = [F.array(own)]
    if "primary_item" in kinds:
        refs.append(F.array(ref(F.col("primary_item"), kinds["primary_item"].names)))
    if "items" in kinds:
        refs.append(F.transform(F.coalesce("items", F.array().cast(kinds["items"])), lambda x: ref(x, kinds["items"].elementType.names)))
    return F.concat(*refs)


def story_refs(stories: DataFrame) -> DataFrame:
    """(story_id, ref columns): the story itself, its primary item and its items (arrays of structs with fields of
    ``REF``)."""
    return stories.select("story_id", F.explode(held_refs(stories)).alias("r")).select("story_id", "r.*")


def identity_keys(stories: DataFrame) -> DataFrame:
    """(story_id, key), some repeated: what tells that two stories are the same: addresses, ids, events and heads of
    titles. A story's items often bear its own title, so each of its titles is read once."""
    refs = stories.select("story_id", held_refs(stories).alias("refs"))
    known = lambda c: F.filter(F.transform("refs", c), lambda v: v.isNotNull())
    given = lambda r, n: F.nullif(r.getField(n), F.lit(""))
    title = lambda r: F.coalesce(*[given(r, n) for n in ("title_zh", "title", "title_en", "title_original")])
    places = F.concat(known(lambda r: F.concat(F.lit("url:"), given(r, "url"))), known(lambda r: F.concat(F.lit("id:"), given(r, "id"))))
    read = F.array_compact(F.array(F.concat(F.lit("event:"), I.event_key(F.col("title"))), F.concat(F.lit("title:"), F.substring(I.event_text(F.col("title")), 1, 34))))
    titles = refs.select("story_id", F.explode(F.array_distinct(known(title))).alias("title")).select("story_id", F.explode(read).alias("key"))
    return refs.select("story_id", F.explode(F.array_distinct(places)).alias("key")).unionByName(titles)


def safe_stories(stories: DataFrame, rules: Rules = NEWS) -> DataFrame:
    """The stories none of whose nested references is unsafe."""
    texts = F.transform(held_refs(stories), lambda r: F.lower(F.concat_ws(" ", *[F.nullif(r.getField(n), F.lit("")) for n in UNSAFE])))
    bad = stories.select("story_id", F.explode(F.array_distinct(texts)).alias("text")).where(is_unsafe(F.col("text"), rules)).select("story_id").distinct()
    return stories.join(bad.hint("merge"), "story_id", "left_anti")


def matching_stories(stories: DataFrame, items: DataFrame, q: ViewQuery) -> DataFrame:
    """The stories that refer to one of the filtered items by URL or id; all, if the query filters nothing."""
    if q.plain:
        return stories
    refs = story_refs(stories)
    keys = items.select(F.explode(F.array_compact(F.array(F.concat(F.lit("url:"), F.nullif("url", F.lit(""))), F.concat(F.lit("id:"), F.col("id").cast("string"))))).alias("key")).distinct()
    held = refs.select("story_id", F.explode(F.array_compact(F.array(F.concat(F.lit("url:"), F.nullif("url", F.lit(""))), F.concat(F.lit("id:"), F.nullif("id", F.lit("")))))).alias("key"))
    return stories.join(held.join(keys, "key", "left_semi").select("story_id").distinct(), "story_id", "left_semi")


def story_pools(brief: DataFrame, merged: DataFrame, items: DataFrame, q: ViewQuery, rules: Rules = NEWS) -> dict[str, DataFrame]:
    """brief, merged and followup (merged stories that share no identity with a brief one), for a query's items."""
    shown, all_ = (matching_stories(safe_stories(s, rules), items, q) for s in (brief, merged))
    # Both grow with the stories, so they aren't broadcast, whatever the size of the files lets the planner expect.
    taken = identity_keys(shown).select("key").distinct()
    seen = identity_keys(all_).join(taken.hint("shuffle_hash"), "key", "left_semi").select("story_id").distinct()
    return {"brief": shown, "merged": all_, "followup": all_.join(seen.hint("merge"), "story_id", "left_anti")}


def ranked_stories(stories: DataFrame, now: Column, view_: str = "hot") -> DataFrame:
    """Stories (story_id, site_id, score, duplicate_count, item_count, earliest_at, latest_at, business_events) with
    badge, hotness, hot_score, percent and place: events first, then heat, score and time. The hot view leaves out
    stories of one source without an event."""
    votes = F.when(F.col("duplicate_count") > 0, F.col("duplicate_count")).otherwise(F.greatest(F.lit(1), F.coalesce("item_count", F.lit(1))))
    latest = F.coalesce("latest_at", "earliest_at")
    age = F.coalesce((F.unix_micros(now) - F.unix_micros(latest)) / 3600e6, F.lit(24.0))
    rated = stories.select("*", votes.alias("votes"), (F.size(F.coalesce("business_events", F.array().cast("array<string>"))) > 0).alias("badge"), hotness(votes, age).alias("hotness"), D.score_percent(F.col("score")).alias("percent"), latest.alias("at"))
    rated = rated.withColumn("hot_score", D.hot_score(F.col("hotness")))
    if view_ == "hot":
        rated = rated.where("hotness > 0 or badge")
    return rated.withColumn("place", F.struct((~F.col("badge")).alias("b"), (-F.col("hot_score")).alias("h"), (-F.col("percent")).alias("p"), (-F.unix_micros(F.coalesce("at", F.lit(0).cast("timestamp")))).alias("t"), "story_id")).drop("votes", "at")


def gated(candidates: DataFrame, community: list[str]) -> DataFrame:
    """Candidates (site_id, badge) that may be featured: those with an event, and others not of a community site."""
    return candidates.where(F.col("badge") | ~F.coalesce(F.col("site_id").isin(community), F.lit(False)))


def candidate_counts(ranked_hot: DataFrame, ranked_all: DataFrame, hot_limit: int = 10, timeline_limit: int = 20) -> DataFrame:
    """One row: how many stories the hot view and the timeline have, and how many of them they show."""
    one = ranked_hot.agg(F.count("*").alias("hot_total")).crossJoin(ranked_all.agg(F.count("*").alias("timeline_total")))
    return one.select(F.least(F.lit(hot_limit), "hot_total").alias("hot"), F.least(F.lit(timeline_limit), "timeline_total").alias("timeline"), "hot_total", "timeline_total")


def header_stats(shown: DataFrame, brief: DataFrame, merged: DataFrame, status: DataFrame) -> DataFrame:
    """One row: items, high ones, stories (the brief, else up to 20 with 75 points), healthy sources, all sources."""
    of = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    items = of(shown, items=F.count("*"), high=F.coalesce(F.sum(F.col("high").cast("long")), F.lit(0)))
    strong = of(merged, strong=F.coalesce(F.sum((D.score_percent(F.col("score")) >= 75).cast("long")), F.lit(0)))
    sites = of(status, healthy=F.coalesce(F.sum(F.col("ok").cast("long")), F.lit(0)), sources=F.count("*"))
    row = items.crossJoin(of(brief, brief=F.count("*"))).crossJoin(strong).crossJoin(sites)  # one row each
    return row.select("items", "high", F.when(F.col("brief") > 0, F.col("brief")).otherwise(F.least(F.lit(20), "strong")).alias("stories"), "healthy", "sources")


def status_table(status: DataFrame, kept: DataFrame, first: int = 12) -> DataFrame:
    """The ``first`` sources (site_id, site_name, ok, item_count) by kept items, with kept, base and percentage.

    ``kept``: (site_id, kept, raw).
    """
    both = status.join(kept, "site_id", "left").select("site_id", "site_name", "ok", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(F.when(F.coalesce("raw", "item_count", F.lit(0)) > 0, F.coalesce("raw", "item_count")), "item_count", F.lit(0)).alias("base"))
    ratio = F.when(F.col("base") > 0, D.half_up(F.col("kept") / F.col("base") * 100)).otherwise(0.0)
    return both.withColumn("percent", ratio).orderBy(F.desc("kept"), F.desc("base"), "site_name", "site_id").limit(first)


def source_health(status: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row of a run's health: sources (site_id, ok, item_count, skipped, advanced) and subscribed feeds (feed_url,
    ok, item_count, skipped, replaced). Skipped and metered sources are no zero-item ones; metered ones without items are
    named apart."""
    names = lambda when, of: F.array_sort(F.collect_list(F.when(when, F.col(of))))
    flag = lambda c: F.coalesce(c, F.lit(False))
    ok, skipped, advanced, none = flag("ok"), flag("skipped"), flag("advanced"), F.coalesce("item_count", F.lit(0)) == 0
    sites = status.agg(F.count("*").alias("sources"), F.count(F.when(ok, 1)).alias("successful"), names(~ok, "site_id").alias("failed_sites"), names(ok & none & ~skipped & ~advanced, "site_id").alias("zero_item_sites"), names(ok & none & ~skipped & advanced, "site_id").alias("empty_advanced"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("items"))
    f = lambda c: F.count(F.when(c, 1))
    feeds = feeds.agg(F.count("*").alias("feeds"), f(flag("ok") & ~flag("skipped")).alias("ok_feeds"), names(~flag("ok") & ~flag("skipped"), "feed_url").alias("failed_feeds"), names(flag("ok") & ~flag("skipped") & (F.coalesce("item_count", F.lit(0)) == 0), "feed_url").alias("zero_item_feeds"), f(flag("skipped")).alias("skipped_feeds"), f(flag("replaced")).alias("replaced_feeds"))
    row = sites.crossJoin(feeds)  # one row each
    return row.select("*", (F.size("failed_sites") + F.size("failed_feeds")).alias("failures"))


# How many stories the views show, the sites that may not fill up the featured ones, the first cards.
HOT_LIMIT, TIMELINE_LIMIT, TOP, FOLLOW_UP = 10, 20, 3, 2
COMMUNITY = ["waytoagi", "followbuilders", "hackernews", "zeli", "aibase"]


def featured_view(pools: dict[str, DataFrame], now: Column, view_: str = "hot") -> DataFrame:
    """The featured stories in order, with ``card``: top for the first three, follow_up for the next two, more behind.

    The pool is the brief and what follows it, or all merged stories without a brief; stories of community sites need an
    event. The hot view gives way to the timeline if it has fewer than two stories. A source takes at most two of the
    first seats where others are as good.
    """
    brief = pools["brief"]
    pool = brief.unionByName(pools["followup"]) if not brief.isEmpty() else pools["merged"]
    ranked = lambda v: gated(ranked_stories(pool, now, v), COMMUNITY)
    hot = ranked("hot")
    if view_ == "hot" and len(hot.select("story_id").take(2)) < 2:
        view_ = "timeline"
    rows = hot if view_ == "hot" else ranked("timeline")
    seats = featured(rows.select(F.col("story_id").alias("id"), "site_id", "badge", F.col("hot_score").alias("hot"), "place"))
    placed = rows.join(seats.select(F.col("id").alias("story_id"), "seat"), "story_id")
    order = [F.col("seat").asc_nulls_last(), F.col("place")]
    few = placed.orderBy(*order).limit(HOT_LIMIT if view_ == "hot" else TIMELINE_LIMIT)
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over the view's few rows
    shown = few.withColumn("n", n)
    return shown.withColumn("card", F.when(F.col("n") <= TOP, "top").when(F.col("n") <= TOP + FOLLOW_UP, "follow_up").otherwise("more"))


def ranked_clusters(shown: DataFrame) -> DataFrame:
    """The events of shown items, best headline first: each with its primary item, sources, merged rows and score."""
    rows = shown.select("event_key", "id", "signal", D.source_priority(F.col("signal")).alias("rank"), F.when(F.col("percent") > 0, F.col("percent")).otherwise(F.col("priority")).alias("score"), "priority", F.coalesce(F.unix_micros("shown_at"), F.lit(0)).alias("ts"))
    clusters = event_clusters(rows.select("event_key", "id", "signal", F.col("rank").alias("priority"), "score", "ts"))
    base = rows.select(F.col("id").alias("primary_id"), F.col("priority").alias("base"), "ts")
    both = clusters.join(base, "primary_id")
    return both.select("event_key", "primary_id", "source_count", "merged_count", headline_score(F.col("base"), F.col("source_count"), F.col("merged_count")).alias("headline"), "ts").orderBy(F.desc("headline"), F.desc("ts"), "primary_id")
