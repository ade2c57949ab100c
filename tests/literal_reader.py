"""Cases of the reader's view over literal stories, items and statuses, beside the rows that must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import display as D
from tidewire.functions import text as X
from tidewire.operators import query

from literal_news import literal, now, registered, values

_STORY = "story_id VARCHAR, site_id VARCHAR, title VARCHAR, url VARCHAR, score DOUBLE, duplicate_count BIGINT, item_count BIGINT, hours DOUBLE, business_events VARCHAR[]"
STORIES = [
    ("s1", "official_ai", "GPT-6 is here for everyone", "https://o/1", 0.9, 3, 4, 1.0, ["model_release"]),
    ("s2", "aibase", "社群 一条 消息 标题", "https://a/2", 0.8, 2, 2, 0.0, []),
    ("s3", "iris", "A single report of some note", "https://i/3", 0.7, 1, 1, 2.0, []),
    ("s4", "iris", "Price cut for the API announced", "https://i/4", 0.6, 1, 1, 3.0, ["pricing"]),
    ("s5", "iris", "Two outlets report one thing", "https://i/5", 0.5, 2, 2, 12.0, []),
    ("s6", "iris", "Virtual girlfriends and nsfw nudes", "https://i/6", 0.9, 5, 5, 0.0, []),
    ("s7", "iris", "Follow-up with the brief's address", "https://o/1", 0.4, 1, 1, 5.0, []),
    ("s8", "newsnow", "Quiet item of a quiet source", "https://n/8", 0.3, 1, 1, 6.0, []),
]
IN_BRIEF = ["s1", "s2"]


def _stories(spark):
    at = now() - F.make_dt_interval(secs=F.col("hours") * 3600)
    rows = literal(spark, _STORY, STORIES)
    item = F.struct(F.concat(F.lit("i"), "story_id").alias("id"), "title", "url")
    return rows.select("story_id", "site_id", "title", "url", "score", "duplicate_count", "item_count", "business_events", at.alias("earliest_at"), at.alias("latest_at"), F.array(item).alias("items"))


def _pools(spark, q=query.ViewQuery(), items=None):
    s = _stories(spark)
    items = literal(spark, "id VARCHAR, url VARCHAR", []) if items is None else items
    return query.story_pools(s.where(F.col("story_id").isin(IN_BRIEF)), s, items, q)


@registered(values("pool VARCHAR, stories VARCHAR[]", [("brief", ["s1", "s2"]), ("merged", ["s1", "s2", "s3", "s4", "s5", "s7", "s8"]), ("followup", ["s3", "s4", "s5", "s8"]), ("of_items", ["s3", "s5"])]))
def story_pools(spark, d):
    of = lambda name, df: df.agg(F.lit(name).alias("pool"), F.array_sort(F.collect_list("story_id")).alias("stories"))
    pools = _pools(spark)
    picked = _pools(spark, query.ViewQuery(site="iris"), literal(spark, "id VARCHAR, url VARCHAR", [("is3", None), ("x", "https://i/5")]))["merged"]
    out = of("of_items", picked)
    for name, df in pools.items():
        out = out.unionByName(of(name, df))
    return out


@registered(values("story_id VARCHAR, badge BOOLEAN, hot_score DOUBLE, percent DOUBLE, n INT, card VARCHAR", [("s1", True, 100.0, 90.0, 1, "top"), ("s4", True, 0.0, 60.0, 2, "top"), ("s5", False, 22.0, 50.0, 3, "top")]))
def featured_stories(spark, d):
    return query.featured_view(_pools(spark), now()).select("story_id", "badge", "hot_score", "percent", "n", "card")


@registered(values("hot BIGINT, timeline BIGINT, hot_total BIGINT, timeline_total BIGINT", [(4, 7, 4, 7)]))
def story_counts(spark, d):
    merged = _pools(spark)["merged"]
    counts = query.candidate_counts(query.ranked_stories(merged, now()), query.ranked_stories(merged, now(), "timeline"))
    return counts.select(*[F.col(c).cast("long").alias(c) for c in counts.columns])


_ITEM = "id VARCHAR, site_id VARCHAR, site_name VARCHAR, source VARCHAR, title VARCHAR, ai_label VARCHAR, ai_score DOUBLE, ai_is_related BOOLEAN, source_tier VARCHAR, source_tier_rank INT, ai_signals VARCHAR[], hours DOUBLE"
ITEMS = [
    ("a", "official_ai", "Official AI Updates", "OpenAI News", "GPT-6 model is here", "model_release", 0.9, True, "official", 0, ["gpt"], 0.0),
    ("b", "socialdata_x", "SocialData X", "@ann", "GPT-6 is here: my notes", "ai_general", 0.65, True, "advanced", 4, [], 24.0),
    ("c", "socialdata_x", "SocialData X", "@bob", "An SDK for robots on GitHub", "developer_tool", 0.7, True, "advanced", 4, ["robot", "sdk"], 48.0),
    ("d", "iris", "Info Flow", "flow", "Weather of the week", "not_ai", 0.1, False, "discussion", 5, None, 1.0),
    ("e", "iris", "Info Flow", "flow", "Nsfw nudes, uncensored pictures", "ai_general", 0.9, True, "discussion", 5, None, 1.0),
]


def _shown(spark):
    rows = literal(spark, _ITEM, ITEMS).withColumn("published_at", now() - F.make_dt_interval(secs=F.col("hours") * 3600)).drop("hours")
    return query.shown_items(rows, now())


@registered(values("id VARCHAR, percent DOUBLE, priority DOUBLE, sections VARCHAR[], source_type VARCHAR, signal VARCHAR, high BOOLEAN, curated BOOLEAN", [
    ("a", 90.0, 87.0, ["models"], "official", "官方更新", True, True),
    ("b", 65.0, 51.0, ["models"], "advanced", "SocialData X", False, False),
    ("c", 70.0, 53.0, ["devtools"], "advanced", "SocialData X", False, False),
    ("d", 10.0, 42.0, ["industry"], "aggregate", "Info Flow", False, False),
]))
def reader_items(spark, d):
    return _shown(spark).select("id", "percent", "priority", "sections", "source_type", "signal", "high", "curated")


@registered(values("query VARCHAR, ids VARCHAR[]", [("all", ["a", "b", "c", "d"]), ("author", ["b"]), ("curated", ["a"]), ("multi", ["a", "b"]), ("selected", ["a"]), ("text", ["c"]), ("type", ["b", "c"])]))
def reader_queries(spark, d):
    asked = {"all": query.ViewQuery(mode="all"), "selected": query.ViewQuery(mode="selected"), "author": query.ViewQuery(author="@ann"), "type": query.ViewQuery(source_type="advanced"), "text": query.ViewQuery(text=" sdk "), "curated": query.ViewQuery(level="curated"), "multi": query.ViewQuery(level="multi")}
    out = None
    for name, q in asked.items():
        one = query.filtered(_shown(spark), q).agg(F.lit(name).alias("query"), F.array_sort(F.collect_list("id")).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(values("sort VARCHAR, ids VARCHAR[]", [("ai", ["a", "c", "b"]), ("latest", ["a", "b", "c"]), ("priority", ["a", "c", "b"]), ("source", ["b", "c", "a"])]))
def reader_sorts(spark, d):
    from pyspark.sql import Window

    out = None
    for sort in ("priority", "latest", "ai", "source"):
        rows, order = query.sort_order(query.mode_items(_shown(spark), "ai"), sort)
        placed = rows.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("n"))
        one = placed.agg(F.lit(sort).alias("sort"), F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(values("author VARCHAR", [("@ann",), ("@bob",)]))
def reader_authors(spark, d):
    return query.authors(literal(spark, _ITEM, ITEMS))


@registered(values("primary_id VARCHAR, source_count BIGINT, merged_count BIGINT, headline DOUBLE", [("a", 2, 2, 100.0), ("c", 1, 1, 53.0), ("d", 1, 1, 42.0)]))
def headline_clusters(spark, d):
    return query.ranked_clusters(_shown(spark)).select("primary_id", "source_count", "merged_count", "headline")


_SITES = "site_id VARCHAR, site_name VARCHAR, ok BOOLEAN, item_count BIGINT"
SITES = [("a", "A", True, 10), ("b", "B", True, 4), ("c", "C", False, 0)]


@registered(values("site_id VARCHAR, ok BOOLEAN, kept BIGINT, base BIGINT, percent DOUBLE", [("a", True, 3, 8, 38.0), ("b", True, 0, 4, 0.0), ("c", False, 0, 0, 0.0)]))
def status_rows(spark, d):
    return query.status_table(literal(spark, _SITES, SITES), literal(spark, "site_id VARCHAR, kept BIGINT, raw BIGINT", [("a", 3, 8)])).select("site_id", "ok", F.col("kept").cast("long").alias("kept"), F.col("base").cast("long").alias("base"), "percent")


@registered(values("items BIGINT, high BIGINT, stories BIGINT, healthy BIGINT, sources BIGINT", [(3, 1, 2, 2, 3)]))
def header_numbers(spark, d):
    pools = _pools(spark)
    row = query.header_stats(query.mode_items(_shown(spark), "ai"), pools["brief"], pools["merged"], literal(spark, _SITES, SITES))
    return row.select(*[F.col(c).cast("long").alias(c) for c in row.columns])


TITLES = [
    (1, "讓法典更好", None, "Codex gets better", None, "讓Codex更好", "Codex gets better"),
    (2, None, "新模型 / A new model arrives", None, None, "新模型", "A new model arrives"),
    (3, None, "Plain English title", None, "Plain English title", "Plain English title", ""),
    (4, None, None, None, None, "未命名更新", ""),
]


@registered(values("id BIGINT, shown VARCHAR, original VARCHAR", [(r[0], r[5], r[6]) for r in TITLES]))
def reader_titles(spark, d):
    rows = literal(spark, "id BIGINT, zh VARCHAR, title VARCHAR, en VARCHAR, orig VARCHAR", [r[:5] for r in TITLES])
    shown = D.shown_title(F.col("zh"), F.col("title"), F.col("en"), F.col("orig"))
    return rows.withColumn("shown", shown).select("id", "shown", D.original_title(F.col("title"), F.lit(None).cast("string"), F.col("en"), F.col("orig"), F.col("shown")).alias("original"))


SPANS = [(1, 0.0, ""), (2, 10.0, "短時集中"), (3, 45.0, "發酵 45 分鐘"), (4, 120.0, "發酵 2小時"), (5, 135.4, "發酵 2小時15分")]


@registered(values("id BIGINT, label VARCHAR", [(i, x) for i, _, x in SPANS]))
def story_spans(spark, d):
    rows = literal(spark, "id BIGINT, minutes DOUBLE", [(i, m) for i, m, _ in SPANS])
    return rows.select("id", D.duration_label(now() - F.make_dt_interval(secs=F.col("minutes") * 60), now()).alias("label"))


@registered(values("id VARCHAR, tags VARCHAR[], label_tone VARCHAR, score_tone VARCHAR, signal_tone VARCHAR, badges VARCHAR[]", [("a", ["多源驗證", "官方", "模型釋出"], "official", "hot", "official", ["模型發布", "價格"]), ("b", ["多源驗證", "模型釋出"], "default", "watch", "builders", ["模型發布", "價格"]), ("c", ["多源驗證", "開發者"], "devtools", "watch", "builders", ["模型發布", "價格"]), ("d", ["多源驗證"], "default", "watch", "default", ["模型發布", "價格"])]))
def reader_tags(spark, d):
    codes = lambda *c: F.array(*map(F.lit, c))
    return _shown(spark).select("id", D.tags("hot", F.col("sections"), F.col("site_id"), F.lit(True)).alias("tags"), D.label_tone(F.col("site_id"), F.col("ai_label"), F.col("sections")).alias("label_tone"), D.score_tone(F.col("percent")).alias("score_tone"), D.signal_tone(F.col("signal")).alias("signal_tone"), D.event_badges(codes("model_release"), codes("model_release", "pricing", "unknown")).alias("badges"))


NESTED = [(1, "mail a@b.org now", ["token=abcdef123 x"], "sk-hynix ships")]


@registered(values("id BIGINT, said VARCHAR, listed VARCHAR[], inner_ VARCHAR", [(1, "mail [redacted-email] now", ["[redacted-secret] x"], "sk-hynix ships")]))
def nested_redaction(spark, d):
    rows = literal(spark, "id BIGINT, said VARCHAR, listed VARCHAR[], inner_ VARCHAR", NESTED).select("id", F.struct("said", "listed", F.struct("inner_").alias("deep")).alias("s"))
    clean = X.redact_all(F.col("s"), rows.schema["s"].dataType)
    return rows.select("id", clean.alias("s")).select("id", "s.said", "s.listed", "s.deep.inner_")


@registered(values("age DOUBLE, lag DOUBLE, warn BOOLEAN, fall_back BOOLEAN", [(1.0, 1.0, False, False), (37.0, 49.0, True, True)]))
def consumer_routes(spark, d):
    rows = literal(spark, "age DOUBLE, lag DOUBLE", [(1.0, 1.0), (37.0, 49.0)])
    return rows.select("age", "lag", D.freshness_route(F.col("age"), F.col("lag")).alias("r")).select("age", "lag", F.col("r.warn_stale").alias("warn"), F.col("r.fall_back_to_items").alias("fall_back"))

