"""What is published: bilingual titles, story records with their links, the brief, the merge log, creators' posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import display as D
from tidewire.functions import items as I
from tidewire.functions import text as X
from tidewire.functions import times, urls
from tidewire.functions.scan import embedded_values
from tidewire.operators import events, scoring, stories
from tidewire.operators.graph import nearest_marked
from tidewire.operators.rank import best_per_key, diverse, votes
from tidewire.plans import dims

# Markers of the published files; the size of the brief; creator sites and their days.
MERGE_STRATEGY, TOPIC_FILTER, BRIEF_ITEMS = "url_or_title_similarity_v0_6", "ai_relevance_scoring_v0_4", 20
CREATOR_SITES, CREATOR_DAYS = ["tikhub_douyin", "tikhub_xiaohongshu"], 7
#: Sources that relay one wire count as one voice.
ECOSYSTEMS = {"aibase": "cn_aggregator", "iris": "cn_aggregator", "kr36_ai": "cn_aggregator", "juya_daily": "cn_aggregator"}

_given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
_table = lambda t: F.create_map(*[F.lit(x) for pair in t.items() for x in pair])


def bilingual(items: DataFrame, all_items: DataFrame, cache: DataFrame) -> DataFrame:
    """``items`` (title, url, provided_title_zh, provided_title_en) with title_original, title_en, title_zh and
    title_bilingual.

    A provided English title wins, beside the provided or own Chinese one; a Chinese title stands for itself; an English
    one takes the Chinese title of another item with its URL (the last by ``ingest_seq``), else of the ``cache`` (title,
    title_zh); nothing is translated. Other titles stay alone. The provided columns go.
    """
    key = lambda: urls.normalize_url(F.coalesce("url", F.lit("")))
    mates = all_items.where(X.has_cjk(F.col("title"))).select(key().alias("_key"), F.trim("title").alias("t"), "ingest_seq").where("_key != ''").groupBy("_key").agg(F.max_by("t", "ingest_seq").alias("_mate"))
    known = cache.select(F.col("title").alias("_said"), F.col("title_zh").alias("_cached")).where("trim(_cached) != ''").groupBy("_said").agg(F.max("_cached").alias("_cached"))
    title = F.trim(F.coalesce("title", F.lit("")))
    joined = items.withColumn("_key", key()).withColumn("_said", title).join(mates, "_key", "left").join(known, "_said", "left")
    english = F.when(F.coalesce(X.is_mostly_english(_given(F.col("provided_title_en"))), F.lit(False)), F.trim("provided_title_en"))
    provided = F.when(X.has_cjk(F.col("provided_title_zh")), F.trim("provided_title_zh")).when(X.has_cjk(title), title)
    own = F.coalesce(X.is_mostly_english(title), F.lit(False))
    found = F.when(own, F.coalesce("_mate", "_cached"))
    both = lambda zh, en: F.when(zh.isNotNull(), F.concat_ws(" / ", zh, en)).otherwise(en)
    zh = F.when(english.isNotNull(), provided).when(X.has_cjk(title), title).otherwise(found)
    columns = [c for c in items.columns if c not in ("provided_title_zh", "provided_title_en", "title_original", "title_en", "title_zh", "title_bilingual")]
    return joined.select(*columns, F.coalesce(english, title).alias("title_original"), F.coalesce(english, F.when(own, title)).alias("title_en"), zh.alias("title_zh"), F.when(english.isNotNull(), both(provided, english)).when(own, both(found, title)).otherwise(title).alias("title_bilingual"))


def shown(items: DataFrame, now: Column) -> DataFrame:
    """Archive rows (id, site_id, site_name, source, title, url, published_at, first_seen_at, summary) as the views have
    them: repaired titles and sources, names for readers, business events, relevance, tier and importance; rows whose
    title only points elsewhere go. ``now`` is the run's clock."""
    from tidewire.sources.feeds import is_pointer

    site = F.col("site_id")
    plain = items.withColumn("title", X.fix_mojibake(F.col("title"))).withColumn("source", X.fix_mojibake(X.shown_source(site, F.col("source"), urls.host(F.coalesce("url", F.lit("")))))).withColumn("site_name", X.site_alias(F.col("site_name")))
    plain = plain.where(~((site == "aihubtoday") & is_pointer(F.col("title"))))
    tagged = plain.withColumn("business_events", events.business_events(site, F.col("title"), F.col("summary")))
    scored = scoring.with_relevance(tagged, F.coalesce(_table(dims.PRIORS)[site], F.lit(0.0)))
    low = F.lower(F.trim(F.coalesce(site, F.lit(""))))
    key = F.when(low.startswith("opmlrss"), "opmlrss").otherwise(low)
    tier = F.coalesce(_table({s: t for s, t, _ in dims.TIERS})[key], F.lit("other"))
    rank = F.coalesce(_table({s: r for s, _, r in dims.TIERS})[key], F.lit(dims.OTHER_RANK))
    at = times.event_time(site, F.col("published_at"), F.col("first_seen_at"))
    return scored.select("*", tier.alias("source_tier"), rank.alias("source_tier_rank"), at.alias("event_time"))


def item_importance(now: Column, duplicates: Column) -> Column:
    """struct(score, editorial, source_tier, ai_relevance, recency, story_heat) of a shown item, rounded to 4 digits."""
    relevance = scoring.relevance_score(F.col("ai_score"), related=F.col("ai_is_related"))
    outside = F.col("aihot_score").try_cast("double")
    editorial = scoring.editorial(outside, F.col("ai_is_related"), relevance, F.col("site_id"))
    tier = F.coalesce(_table(dims.TIER_WEIGHTS)[F.col("source_tier")], F.lit(dims.TIER_WEIGHTS["other"]))
    fresh = scoring.freshness((F.unix_micros(now) - F.unix_micros("event_time")) / 3600e6)
    heat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (duplicates - 1) / 4))
    score = scoring.importance(editorial, tier, relevance, fresh, duplicates)
    parts = [("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), ("editorial", editorial), ("source_tier", tier), ("ai_relevance", relevance), ("recency", fresh), ("story_heat", heat)]
    return F.struct(*[F.round(c, 4).alias(n) for n, c in parts])


def item_links(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(story_id, link columns): the items of each story as its record links them; a table of its own, however many."""
    title = F.coalesce("title_bilingual", "title")
    link = [F.col("id"), title.alias("title"), F.col("title_zh"), F.col("title_en"), F.col("title_original"), F.col("summary"), F.col("url"), F.col("source"), F.col("site_name").alias("source_name"), F.col("site_id"), F.col("published_at")]
    return named_stories(items, clusters).join(items.select(*link), "id").select("story_id", *[c for c in ("id", "title", "title_zh", "title_en", "title_original", "summary", "url", "source", "source_name", "site_id", "published_at")])


def named_stories(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, story_id): each item's story, named by its leader."""
    leader = items.select(F.col("id").alias("leader"), urls.story_id(F.col("url"), F.col("story_title"), F.col("id")).alias("story_id"))
    return clusters.select("id", "leader").join(leader, "leader").select("id", "story_id")


def story_items(items: DataFrame) -> DataFrame:
    """Bilingual shown items with ``story_title``, the title that stories compare."""
    return items.withColumn("story_title", X.story_title(F.col("title_original"), F.col("title"), F.col("title_bilingual")))


def merged_stories(items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(stories, merge events) of bilingual shown items: see ``stories.story_clusters`` for what merges.

    A story has its primary item (tier, importance, time, title), the numbers of its items and of independent voices,
    names, events, score with breakdown, label, category, reasons, and its first and last time. Partial aggregation only;
    ``item_links`` has the items.
    """
    own = story_items(items)
    grouped = stories.story_clusters(own.select("id", F.col("story_title").alias("title"), urls.canonical_url(F.coalesce("url", F.lit(""))).alias("url"), "event_time", F.col("source_tier_rank").alias("tier_rank")))
    grouped = stories.settled(grouped)
    named = named_stories(own, grouped)
    rows = own.join(named, "id").withColumn("_i", item_importance(now, F.lit(1)))
    ts = F.coalesce(F.unix_micros("event_time"), F.lit(0))
    order = F.struct(F.col("source_tier_rank").alias("a"), (-F.col("_i.score")).alias("b"), (-ts).alias("c"), F.col("title").alias("d"), F.col("id").alias("e"))
    keep = ["id", "title", "title_zh", "title_en", "title_original", "title_bilingual", "summary", "url", "source", "site_name", "site_id", "source_tier", "ai_score", "ai_is_related", "aihot_score", "event_time"]
    told = F.coalesce(_given(F.col("source")), _given(F.col("site_name")))
    eco = _table(ECOSYSTEMS)[F.col("site_id")]
    one = rows.groupBy("story_id").agg(
        F.min_by(F.struct(*keep), order).alias("p"),
        F.count("*").alias("item_count"),
        F.count_distinct("site_id", "source").alias("distinct_source_count"),
        votes(eco, F.col("id")).alias("duplicate_count"),
        F.array_sort(F.collect_set(told)).alias("source_names"),
        F.min("event_time").alias("earliest_at"),
        F.max("event_time").alias("latest_at"),
    )
    tags = rows.select("story_id", F.explode("business_events").alias("e")).groupBy("story_id").agg(F.array_sort(F.collect_set("e")).alias("business_events"))
    both = one.join(tags, "story_id", "left").select("story_id", "p.*", "item_count", "distinct_source_count", "duplicate_count", "source_names", F.coalesce("business_events", F.array().cast("array<string>")).alias("business_events"), "earliest_at", "latest_at")
    rated = both.withColumn("i", item_importance(now, F.col("duplicate_count")))
    score, tier, n = F.col("i.score"), F.col("source_tier"), F.col("duplicate_count")
    kind = I.category(score, tier, n)
    primary = F.struct(*[F.col(c) for c in ("id", "title", "title_zh", "title_en", "title_original", "summary", "url", "source")], F.col("site_name").alias("source_name"), "site_id")
    relevance = scoring.relevance_score(F.col("ai_score"), related=F.col("ai_is_related"))
    out = rated.select("story_id", F.coalesce("title_bilingual", "title").alias("title"), "url", "source", F.col("site_name").alias("source_name"), "site_id", F.col("item_count").alias("source_count"), "item_count", "distinct_source_count", "duplicate_count", "source_names", "business_events", score.alias("score"), D.importance_label(kind).alias("importance_label"), F.col("i").alias("importance_breakdown"), kind.alias("category"), I.reasons(score, tier, n, relevance).alias("reasons"), "earliest_at", "latest_at", primary.alias("primary_item"))
    merged = grouped.where("reason is not null").join(named, "id").select("story_id", F.col("id").alias("item_id"), F.col("story_id").alias("merged_into"), "reason", F.round("similarity", 4).alias("similarity"))
    return out, merged


def story_order() -> list[Column]:
    return [F.desc("score"), F.col("latest_at"), F.col("title"), F.col("story_id")]


def in_brief(source_count: Column, score: Column) -> Column:
    return (source_count >= 2) | (score >= dims.BRIEF_AT)


def daily_brief(stories_: DataFrame, items: int = BRIEF_ITEMS) -> DataFrame:
    """The stories of the brief with their place: those that several items confirm or that score high, greedily picked."""
    gated = stories_.where(in_brief(F.col("source_count"), F.col("score")))
    title = X.story_title(F.col("primary_item.title_original"), F.col("title"), F.col("title"))
    picked = diverse(gated.select("story_id", F.coalesce(_given(F.col("source")), F.col("source_name")).alias("source"), title.alias("title"), "score"), items)
    return gated.join(F.broadcast(picked), "story_id")  # at most ``items`` rows


def header(rows: DataFrame, generated: Column, count: str, **constants) -> DataFrame:
    """One row: what stands above a published list, with the number of its rows as ``count``."""
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    return rows.agg(F.count("*").alias(count)).select(times.iso(generated).alias("generated_at"), *fixed, count)


def merge_log(events_: DataFrame, generated: Column) -> DataFrame:
    return header(events_, generated, "total_events", merge_strategy=MERGE_STRATEGY)


def latest_views(ai: DataFrame, everything: DataFrame, generated: Column, hours: int = dims.WINDOW_HOURS) -> dict[str, DataFrame]:
    """The slim view of related items, and the bulky one of all items that readers load on demand, each with its header."""
    common = {"window_hours": hours, "topic_filter": TOPIC_FILTER, "ai_relevance_threshold": dims.KEEP_AT}
    slim = header(ai, generated, "total_items", **common, all_mode_data_url="data/latest-24h-all.json", stories_data_url="data/stories-merged.json")
    return {"latest": ai, "latest_header": slim, "all": everything, "all_header": header(everything, generated, "total_items_all_mode", **common)}


def deduplicated(items: DataFrame) -> DataFrame:
    """One item for each title and address (for one digest site: each address), the best by tier, time and title."""
    title = F.lower(F.trim(F.coalesce(_given(F.col("title_original")), F.col("title"), F.lit(""))))
    key = F.when(F.lower("site_id") == "aihubtoday", F.lit("")).otherwise(F.concat(title, F.lit("||")))
    keyed = items.withColumn("_key", F.concat(key, urls.normalize_url(F.coalesce("url", F.lit("")))))
    order = F.struct(F.col("source_tier_rank").alias("a"), (-F.coalesce(F.unix_micros("event_time"), F.lit(0))).alias("b"), F.col("title").alias("c"), F.col("id").alias("d"))
    return best_per_key(keyed, ["_key"], order).drop("_key")


def creator_hot(archive: DataFrame, now: Column, ai_only: bool) -> DataFrame:
    """Creators' posts of the last week (creator_metrics: likes, comments, collects, shares), shown, each once, the
    hottest first; only related ones if ``ai_only``."""
    at = times.event_time(F.col("site_id"), F.col("published_at"), F.col("first_seen_at"))
    recent = (at >= now - F.make_dt_interval(days=F.lit(CREATOR_DAYS))) & (at <= now)
    rows = shown(archive.where(F.col("site_id").isin(CREATOR_SITES) & F.col("creator_metrics").isNotNull() & recent), now)
    if ai_only:
        rows = rows.where("ai_is_related")
    for c in ("title_original", "title_bilingual"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    rows = stories.settled(deduplicated(rows))
    m, age = F.col("creator_metrics"), (F.unix_micros(now) - F.unix_micros("event_time")) / 3600e6
    ranked = rows.withColumn("r", scoring.creator_ranking(F.col("site_id"), m["likes"], m["comments"], m["collects"], m["shares"], age))
    kept = stories.suppress_near_duplicates(story_items(rows).select("id", "site_id", F.col("story_title").alias("title"), "event_time", F.col("source_tier_rank").alias("tier_rank"), F.col("ai_score").alias("score")))
    out = ranked.join(kept.select("id"), "id", "left_semi")
    return out.select(*[c for c in out.columns if c != "r"], *[F.col(f"r.{n}").alias(f"creator_{t}") for n, t in (("engagement", "engagement_total"), ("heat", "heat_score"), ("bonus", "freshness_bonus"), ("hot", "hot_score"))]).orderBy(F.desc("creator_hot_score"), F.desc("event_time"), "id")


def block_updates(blocks: DataFrame, today: Column, hops: int = 20) -> DataFrame:
    """(date, title) of a wiki page's log entries: each text block (id, parent_id, type, text) dated by its nearest dated
    heading above, up to ``hops`` levels; each date and title once.

    If a heading announces the log of the last days, only headings beside it count. A heading's year is that of the
    month heading above it, but a date over two days ahead of ``today`` is last year's.
    """
    titled = F.col("type").isin("heading1", "heading2", "heading3")
    flat = F.regexp_replace("text", r"\s+", "")
    logs = blocks.where(titled & F.contains(flat, F.lit("近7日更新日志")) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("log")).distinct()
    some = logs.agg((F.count("*") > 0).alias("some"))  # one row
    md = times.month_day(F.col("text"))
    days = blocks.where((F.col("type") == "heading3") & md.isNotNull()).select(F.col("id").alias("head"), F.col("parent_id").alias("log"), md.alias("md"))
    beside = days.join(logs.withColumn("named", F.lit(True)), "log", "left").join(F.broadcast(some)).where("named or not some")
    month, day = F.col("md.month"), F.col("md.day")
    dated = beside.select("head", F.try_to_date(F.format_string("%04d-%02d-%02d", I.year_of_date(month, day, today), month, day), "yyyy-MM-dd").alias("date")).where("date is not null")
    above = nearest_marked(blocks.select("id", F.nullif(F.trim("parent_id"), F.lit("")).alias("parent")), dated.select(F.col("head").alias("id")))
    texts = blocks.where(F.col("type").isin("bullet", "text", "todo", "ordered")).select("id", "text")
    found = texts.join(above.where(F.col("up") <= hops).select("id", F.col("nearest").alias("head")), "id").join(dated, "head")
    title = F.trim(F.regexp_replace(F.regexp_replace("text", "《 ?》", ""), r"\s+", " "))
    return found.select("date", title.alias("title")).where("title != ''").distinct()


def recent_updates(pages: list[DataFrame], today: Column, days: int = 7) -> DataFrame:
    """(date, title, latest) of several pages' updates of the last days, each once; latest marks those of the last date."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    recent = out.distinct().where((F.col("date") <= today) & (F.col("date") > F.date_sub(today, days)))
    return recent.join(F.broadcast(recent.agg(F.max("date").alias("last")))).select("date", "title", (F.col("date") == F.col("last")).alias("latest"))


def wiki_history(pages: DataFrame, column: str = "payload") -> DataFrame:
    """The other columns of wiki pages with history_url and client_vars: the link to the log of changes and the JSON that
    the page's script assigns; null where there is none."""
    link = F.regexp_extract(column, r'(https?://[^"\s<>]+/wiki/[A-Za-z0-9]+)[^<>]{0,200}?(?:更新日志|历史更新)', 1)
    held = F.get(embedded_values(F.col(column), r"clientVars\s*[:=]\s*(?:Object\()?"), F.lit(0))
    return pages.select(*[c for c in pages.columns if c != column], F.nullif(link, F.lit("")).alias("history_url"), held.alias("client_vars"))
