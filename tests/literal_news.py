"""Cases over small literal tables of news: inputs as sources give them, beside the rows they must become.

The given tables hold no news, so the real rule tables and the parsers run here on items written for them. Where the
rules are tables, the SQL states their meaning; for parsers it states the rows that must come out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import times
from tidewire.operators import events, gates, payloads, query, scoring
from tidewire.plans import dims, sqltext
from tidewire.sources import feeds, pages, services

NOW = dt.datetime(2026, 7, 24, 18)
QUERIES, SQL = {}, {}


def registered(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def now():
    return F.lit("2026-07-24 18:00:00").cast("timestamp")


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
    return sqltext.quoted(v) if isinstance(v, str) else repr(v)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table; ``columns``: name type, ..."""
    named = [c.strip().split(" ", 1) for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in named)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in named)})"


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns.replace("VARCHAR[]", "array<string>").replace("VARCHAR", "string").replace("BIGINT", "long"))


_COLUMNS = "id BIGINT, site_id VARCHAR, site_name VARCHAR, source VARCHAR, title VARCHAR, summary VARCHAR, url VARCHAR"
ITEMS = [
    (1, "official_ai", "Official AI Updates", "OpenAI News", "OpenAI releases GPT-6 model for developers", None, "https://openai.com/gpt-6?utm_source=rss"),
    (2, "curated_media", "Curated Media", "TechCrunch AI", "Mistral raises funding at record valuation", "The company reported quarterly revenue.", "https://techcrunch.com/a"),
    (3, "curated_media", "Curated Media", "MarkTechPost Research", "Ten gardens worth a visit", None, "https://marktechpost.com/b"),
    (4, "curated_media", "Curated Media", "The Verge", "A quiet week for phones", None, "https://theverge.com/c"),
    (5, "tophub", "TopHub", "淘宝 · 热销总榜", "GPT 周边促销", None, "https://tophub.today/d"),
    (6, "tophub", "TopHub", "知乎 · 日报", "大模型 推理 成本", None, "https://tophub.today/e"),
    (7, "tophub", "TopHub", "机器之心 · 热门", "大模型 推理 成本 下降", None, "https://tophub.today/f"),
    (8, "zeli", "Zeli", "Zeli · 24h", "Show: my weekend boat", None, "https://a.example/g"),
    (9, "zeli", "Zeli", "Hacker News · 24h最热", "OpenAI ships it", None, "https://a.example/h"),
    (10, "iris", "Info Flow", "flow", "How to prompt Claude for better tests", None, "https://b.example/i"),
    (11, "iris", "Info Flow", "flow", "手把手教你部署 DeepSeek 保姆级教程", None, "https://b.example/j"),
    (12, "iris", "Info Flow", "flow", "OpenAI in talks", None, "https://www.v2ex.com/k"),
    (13, "aibase", "AIbase", "AIbase", "城市新闻", None, "https://www.aibase.com/l"),
    (14, "opmlrss", "OPML RSS", "Blog", "Why agents need better developer sandboxes", None, "https://c.example/m"),
    (15, "opmlrss", "OPML RSS", "Blog", "明星八卦:篮球之夜", None, "https://c.example/llm/gpt"),
    (16, "opmlrss", "OPML RSS", "Blog", "uncensored pictures and nsfw nudes by AI", None, "https://c.example/o"),
    (17, "opmlrss", "OPML RSS", "Blog", "OpenAI updates its nsfw rules", None, "https://c.example/p"),
    (18, "newsnow", "NewsNow", "News", "Company merger approved after acquisition deal", "merge branches", "https://d.example/q"),
    (19, "newsnow", "NewsNow", "News", "How we merge branches: merger of two git trees", None, "https://d.example/r"),
    (20, "newsnow", "NewsNow", "News", "黑客马拉松 漏洞 修复竞赛", None, "https://d.example/s"),
    (21, "newsnow", "NewsNow", "News", "Zero-day exploit hits GPU cloud", None, "https://d.example/t"),
    (22, "newsnow", "NewsNow", "News", "Building with an SDK: latency dashboards and eval checks", None, "https://d.example/u"),
    (23, "newsnow", "NewsNow", "News", "New eval shows Qwen ahead", None, "https://d.example/v"),
    (24, "juya_daily", "橘鴉AI早報", "橘鴉AI早報", "日報 2026-07-24 revenue acquisition exploit", None, "https://daily.example/w"),
    (25, "newsnow", "NewsNow", "News", "Grok open-sources build; a model appears elsewhere", None, "https://d.example/x"),
    (26, "newsnow", "NewsNow", "News", "philosophy of price cuts: a price cut explained", None, "https://d.example/y"),
    (27, "newsnow", "NewsNow", "News", "阿里发布新模型,参数翻倍", None, "https://d.example/z"),
    (28, None, None, None, None, None, None),
]
_PRIOR = "CASE site_id " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in dims.PRIORS.items()) + " ELSE 0.0 END"
_ITEM_SQL = f"WITH i AS ({values(_COLUMNS, ITEMS)})"


@registered(f"""{_ITEM_SQL}, x AS (SELECT id, coalesce(site_id, '') AS site_id, lower(coalesce(source, '')) AS src, lower(coalesce(title, '')) AS lt, lower(coalesce(site_name, '')) AS sn, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM i),
y AS (SELECT *, concat_ws(' ', lt, src, sn, host) AS low FROM x), r AS (SELECT id, low, {sqltext.site_relevance(scoring.NEWS, scoring.NEWS_SCOPE, _PRIOR)} FROM y)
SELECT id, related AS ai_is_related, score AS ai_score, label AS ai_label, reason AS ai_relevance_reason FROM r""")
def news_relevance(spark, d):
    items = literal(spark, _COLUMNS, ITEMS)
    prior = F.coalesce(F.create_map(*[F.lit(x) for pair in dims.PRIORS.items() for x in pair])[F.col("site_id")], F.lit(0.0))
    return scoring.with_relevance(items, prior).select("id", "ai_is_related", "ai_score", "ai_label", "ai_relevance_reason")


@registered(values("id BIGINT, ai_signals VARCHAR[], ai_noise VARCHAR[]", [(1, ["gpt", "openai", "developer"], []), (5, ["gpt"], ["促销", "淘宝", "热销总榜"]), (8, ["zeli_24h_hot"], []), (10, ["claude", "prompt"], ["how to"]), (11, ["deepseek"], ["保姆级", "手把手", "教程"]), (13, ["aibase"], []), (16, [], ["unsafe_promotional_content"])]))
def news_signals(spark, d):
    prior = F.lit(0.0)
    found = scoring.with_relevance(literal(spark, _COLUMNS, ITEMS), prior).where(F.col("id").isin(1, 5, 8, 10, 11, 13, 16))
    return found.select("id", F.concat(F.filter("ai_signals", lambda s: ~s.isin("cloud", "developer")), F.filter("ai_signals", lambda s: s.isin("cloud", "developer"))).alias("ai_signals"), "ai_noise")


@registered(f"{_ITEM_SQL} SELECT id, {sqltext.events(events.NEWS_EVENTS)} AS business_events FROM i")
def news_events(spark, d):
    return literal(spark, _COLUMNS, ITEMS).select("id", events.business_events(F.col("site_id"), F.col("title"), F.col("summary")).alias("business_events"))


# What a source says of a time, beside the time it means (at 2026-07-24 18:00 UTC).
TIMES = [
    ("Fri, 24 Jul 2026 10:00:00 GMT", dt.datetime(2026, 7, 24, 10)),
    ("Fri, 24 Jul 2026 10:00:00 +0800", dt.datetime(2026, 7, 24, 2)),
    ("24 July 2026 10:00 PDT", dt.datetime(2026, 7, 24, 17)),
    ("2026-07-24T10:00:00Z", dt.datetime(2026, 7, 24, 10)),
    ("2026-07-24T10:00:00.123+02:00", dt.datetime(2026, 7, 24, 8)),
    ("2026-07-24 10:00", dt.datetime(2026, 7, 24, 10)),
    ("2026/07/04", dt.datetime(2026, 7, 4)),
    ("2026-07-24 11:54:21AM UTC", dt.datetime(2026, 7, 24, 11, 54, 21)),
    ("2026-07-24 12:05:00PM UTC", dt.datetime(2026, 7, 24, 12, 5)),
    ("Jul 4, 2026", dt.datetime(2026, 7, 4)),
    ("July 4th, 2026 3:30 PM EST", dt.datetime(2026, 7, 4, 20, 30)),
    ("1784887200", dt.datetime(2026, 7, 24, 10)),
    ("1784887200000", dt.datetime(2026, 7, 24, 10)),
    ("$D2026-07-24T10:00:00Z", dt.datetime(2026, 7, 24, 10)),
    ("3小时前", dt.datetime(2026, 7, 24, 15)),
    ("昨天", dt.datetime(2026, 7, 23, 18)),
    ("12:30", dt.datetime(2026, 7, 24, 12, 30)),
    ("23:30", dt.datetime(2026, 7, 23, 23, 30)),
    ("8月1日", dt.datetime(2025, 8, 1)),
    ("soon", None),
    ("2026-02-30", None),
    ("", None),
]


@registered(values("said VARCHAR, meant TIMESTAMP", TIMES))
def source_times(spark, d):
    return literal(spark, "said VARCHAR", [(s,) for s, _ in TIMES]).select("said", times.parse_any(F.col("said"), now()).alias("meant"))


MENDED = [("ÃŸ FranÃ§ais", "ß Français"), ("itâ€™s", "it’s"), ("naÃ¯ve Ÿ", "naÃ¯ve Ÿ"), ("é ÿ plain", "é ÿ plain"), ("  plain ", "plain"), ("å\x8f\x91å¸\x83", "发布"), ("", "")]


@registered(values("said VARCHAR, mended VARCHAR", MENDED))
def mended_texts(spark, d):
    return literal(spark, "said VARCHAR", [(s,) for s, _ in MENDED]).select("said", X.fix_mojibake(F.col("said")).alias("mended"))


RSS = """<rss><channel><item><title>AI &amp; chips &#8212; a view</title><link>https://f.example/1?utm_source=x</link><pubDate>Fri, 24 Jul 2026 10:00:00 GMT</pubDate></item>
<item><title><![CDATA[Robots & AI]]></title><link>https://f.example/2</link><pubDate>Thu, 23 Jul 2026 10:00:00 GMT</pubDate></item>
<item><title>Gardens of Spain</title><link>https://f.example/3</link><pubDate>Thu, 23 Jul 2026 10:00:00 GMT</pubDate></item>
<item><title>AI again</title><link>https://f.example/1</link><pubDate>Fri, 24 Jul 2026 11:00:00 GMT</pubDate></item>
<item><title>Old AI story</title><link>https://f.example/4</link><pubDate>Fri, 24 Apr 2026 11:00:00 GMT</pubDate></item>
<item><title>Undated AI story</title><link>https://f.example/5</link></item>
<item><title>Last AI story</title><link>https://f.example/6</link><pubDate>Wed, 22 Jul 2026 11:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>2026-07-24</title><link href="https://g.example/1"/><updated>2026-07-24T01:00:00Z</updated></entry>
<entry><title>详情</title><link href="https://g.example/2"/><updated>2026-07-24T01:00:00Z</updated></entry><entry><title>no link</title></entry></feed>"""
CATALOGUE = [("f", "curated_media", "Curated Media", "F News", ["ai", "robots"], True, 30, 2, True, 1, None), ("g", "juya_daily", "Daily", "G Daily", [], False, 5, None, True, 1, "Morning")]
FEED_ROWS = [
    ("f", "curated_media", "F News", "AI & chips — a view", "https://f.example/1?utm_source=x", dt.datetime(2026, 7, 24, 10)),
    ("f", "curated_media", "F News", "Robots & AI", "https://f.example/2", dt.datetime(2026, 7, 23, 10)),
    ("g", "juya_daily", "G Daily", "Morning 2026-07-24", "https://g.example/1", dt.datetime(2026, 7, 24, 1)),
]
_ROWS = "feed VARCHAR, site_id VARCHAR, source VARCHAR, title VARCHAR, url VARCHAR, published TIMESTAMP"


@registered(values(_ROWS, FEED_ROWS))
def catalogue_feeds(spark, d):
    stored = literal(spark, "feed VARCHAR, payload VARCHAR", [("f", RSS), ("g", ATOM), ("unknown", RSS), ("g", None)])
    return feeds.catalogue_items(stored, spark.createDataFrame(CATALOGUE, feeds.CATALOGUE), now()).select("feed", "site_id", "source", "title", "url", "published")


@registered(values("site_id VARCHAR, ok BOOLEAN, item_count BIGINT, error VARCHAR, items BIGINT", [("feeds", True, 3, None, 3), ("broken", False, 0, "ValueError", 0), ("empty", False, 0, "no items parsed", 0), ("blocks", True, 3, None, 3)]))
def collected_sources(spark, d):
    def broken():
        raise ValueError("unreadable")

    none = lambda: services.hot_posts(literal(spark, "payload VARCHAR", [("{}",)]), now())
    items, statuses = feeds.collected({"feeds": lambda: catalogue_feeds(spark, d), "broken": broken, "empty": none, "blocks": lambda: services.source_blocks(literal(spark, "payload VARCHAR", [(BLOCKS,)]), now())})
    counted = items.groupBy(F.floor(F.col("ingest_seq") / (1 << 53)).cast("int").alias("n")).agg(F.count("*").alias("items"))
    status = spark.createDataFrame([(n, s["site_id"], s["ok"], s["item_count"], s["error"]) for n, s in enumerate(statuses)], "n int, site_id string, ok boolean, item_count long, error string")
    return status.join(counted, "n", "left").select("site_id", "ok", "item_count", "error", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


PAGES = {
    "anthropic_news": """<main><a href="/news"><h2>News</h2></a><a href="/news/one"><div><h3>One <b>model</b></h3><time datetime="2026-07-20">x</time></div></a>
<a href="/news/one"><h3>Again</h3><time>Jul 21, 2026</time></a><a href="/news/two"><h4>Two</h4></a><a href="/news/old"><h4>Old</h4><time>Jan 2, 2026</time></a></main>""",
    "codex_changelog": """<ul id="codex-changelog-content"><li id="v1"><time>2026-07-22</time><h3>Codex 1 &amp; more</h3></li><li><h3>no id</h3></li><li id="v2"><h3>no time</h3></li></ul>""",
    "aibase": """<a href="/news/7"><h3>标题 七</h3><div class="text-sm text-gray-400"><span>2小时前</span></div></a><a href="/news/8"><p>none</p></a>""",
    "techurls": """<div class="publisher-block" data-publisher="p"><div class="publisher-text"><span class="primary">Site</span><span class="secondary">Top</span></div>
<div class="publisher-link"><a class="article-link" href="https://s.example/1">First</a><div class="aside"><span class="text" title="2026-07-24 11:54:21AM UTC">1h</span></div></div>
<div class="publisher-link"><a class="article-link" href="https://s.example/2">Second</a></div></div>""",
    "tophub": """<div class="cc-cd"><div class="cc-cd-lb"><span>知乎</span></div><div class="cc-cd-sb-st">热榜</div><div class="cc-cd-cb-l"><a href="/n/1"><div class="cc-cd-cb-ll"><span class="t">话题</span><span class="e">9万</span></div></a><a href=""><div class="cc-cd-cb-ll"><span class="t">none</span></div></a></div></div>""",
    "telegram": """<div class="tgme_widget_message" data-post="chan/5"><div class="tgme_widget_message_text">Hello<br>world</div><time datetime="2026-07-24T09:00:00+00:00">09:00</time></div>
<div class="tgme_widget_message" data-post="chan/6"><div class="tgme_widget_message_link_preview_title">Preview</div><time datetime="2026-07-24T09:30:00+00:00"></time></div><div class="tgme_widget_message" data-post="chan/7"><div class="tgme_widget_message_text">undated</div></div>""",
}
PAGE_ROWS = [
    ("anthropic_news", "Anthropic News", "One model", "https://www.anthropic.com/news/one", dt.datetime(2026, 7, 20)),
    ("codex_changelog", "OpenAI Codex Changelog", "Codex 1 & more", "https://developers.openai.com/codex/changelog#v1", dt.datetime(2026, 7, 22)),
    ("aibase", "AIbase", "标题 七", "https://www.aibase.com/news/7", dt.datetime(2026, 7, 24, 16)),
    ("techurls", "Site · Top", "First", "https://s.example/1", dt.datetime(2026, 7, 24, 11, 54, 21)),
    ("techurls", "Site · Top", "Second", "https://s.example/2", None),
    ("tophub", "知乎 · 热榜", "话题", "https://tophub.today/n/1", None),
    ("telegram", "OPML RSS", "Hello world", "https://t.me/chan/5", dt.datetime(2026, 7, 24, 9)),
    ("telegram", "OPML RSS", "Preview", "https://t.me/chan/6", dt.datetime(2026, 7, 24, 9, 30)),
]


@registered(values("page VARCHAR, source VARCHAR, title VARCHAR, url VARCHAR, published TIMESTAMP", PAGE_ROWS))
def item_pages(spark, d):
    out = None
    for name, html in PAGES.items():
        one = pages.page_rows(literal(spark, "payload VARCHAR", [(html,), (None,), ("",)]), pages.PAGES[name], now()).select(F.lit(name).alias("page"), "source", "title", "url", "published")
        out = one if out is None else out.unionByName(one)
    return out


BUZZ = '{"items": [{"title": " A ", "url": "https://www.h.example/1", "channel": "Chan", "date_published": "2026-07-24T01:00:00Z"}, {"title": "B", "url": "https://www.h.example/2"}, {"title": "", "url": "https://h/3"}]}'
HOT = '{"posts": [{"id": 1, "title": "Hot", "url": "https://h/1", "time": 1784887200}, {"id": 2, "title": "Untimed", "url": "https://h/2"}]}'
BLOCKS = '{"data": [{"id": "v2ex", "title": "V2EX", "updatedTime": 1784887200000, "items": [{"title": "X", "url": "https://v/1"}, {"title": "Y", "url": "https://v/2", "extra": {"date": "2026-07-23"}}]}, {"id": "github", "items": [{"title": "Z", "url": "https://g/1", "pubDate": "2026-07-22"}, {"title": "", "url": "u"}]}]}'
FOUND = '{"data": [{"id": "9", "text": "Hello  there a@b.org", "author_id": "7", "created_at": "2026-07-24T02:00:00Z"}, {"id": "8", "text": "By nobody", "author_id": "5"}, {"id": "", "text": "none"}], "includes": {"users": [{"id": "7", "username": "ann"}]}}'
JIKE = '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"posts": [{"id": "p1", "content": "一条 动态", "createdAt": "2026-07-24T03:00:00Z"}, {"id": "p2", "content": "undated"}]}}}</script>'
ISSUES = '{"data": {"pageCount": 1, "dataList": [{"id": "5", "title": "Issue 5", "createdTimestamp": 1784887200000}, {"id": "5", "title": "Issue 5", "createdTimestamp": 1784887200000}]}}'
AT = dt.datetime(2026, 7, 24, 10)
SERVICE_ROWS = [
    ("buzzing", "Chan", "A", "https://www.h.example/1", dt.datetime(2026, 7, 24, 1)),
    ("buzzing", "www.h.example", "B", "https://www.h.example/2", None),
    ("zeli", "Hacker News · 24h最热", "Hot", "https://h/1", AT),
    ("zeli", "Hacker News · 24h最热", "Untimed", "https://h/2", NOW),
    ("newsnow", "V2EX (v2ex)", "X", "https://v/1", AT),
    ("newsnow", "V2EX (v2ex)", "Y", "https://v/2", dt.datetime(2026, 7, 23)),
    ("newsnow", "github", "Z", "https://g/1", dt.datetime(2026, 7, 22)),
    ("xapi", "@ann", "Hello there [redacted-email]", "https://x.com/ann/status/9", dt.datetime(2026, 7, 24, 2)),
    ("xapi", "@i/web", "By nobody", "https://x.com/i/web/status/8", NOW),
    ("opmlrss", "Jike", "一条 动态", "https://m.okjike.com/originalPosts/p1", dt.datetime(2026, 7, 24, 3)),
    ("bestblogs", "Weekly Newsletter", "Issue 5", "https://www.bestblogs.dev/en/newsletter#5", AT),
]


@registered(values("site_id VARCHAR, source VARCHAR, title VARCHAR, url VARCHAR, published TIMESTAMP", SERVICE_ROWS))
def service_items(spark, d):
    of = lambda *p: literal(spark, "payload VARCHAR", [*[(x,) for x in p], (None,), ("{",)])
    parts = [services.aggregator_feed(of(BUZZ), now()), services.hot_posts(of(HOT), now()), services.source_blocks(of(BLOCKS), now()), services.searched_posts(of(FOUND), now()), pages.embedded_posts(of(JIKE), F.lit("Jike"), now()), services.newsletter_issues(of(ISSUES), of("<a href='/newsletter/1'>A long enough title</a>"), now())]
    out = None
    for p in parts:
        p = p.select("site_id", "source", "title", "url", "published")
        out = p if out is None else out.unionByName(p)
    return out


TWEETS = '{"tweets": [{"id_str": "1", "full_text": "one", "user": {"screen_name": "@ann"}, "tweet_created_at": "2026-07-24T02:00:00Z"}, {"id_str": "1", "full_text": "one", "user": {"screen_name": "ann"}}, {"id_str": "2", "type": "retweet", "full_text": "rt", "user": {"screen_name": "ann"}}, {"id_str": "3", "full_text": "ad", "user": {"screen_name": "Spam"}}, {"id_str": "4", "full_text": "egg", "user": {"screen_name": "egg", "default_profile_image": true}}, {"id_str": "5", "full_text": " ", "user": {"screen_name": "ann"}}, {"id": "6", "type": "quote", "text": "six", "user": {"screen_name": "bob"}, "created_at": "2026-07-24T03:00:00Z"}]}'


@registered(values("skipped VARCHAR, n BIGINT", [("bot_like", 1), ("duplicate", 1), ("empty", 1), ("excluded_author", 1), ("kept", 2), ("retweet_or_reply", 1)]))
def followed_list(spark, d):
    tagged = services.tagged_posts(literal(spark, "page BIGINT, payload VARCHAR", [(0, TWEETS), (1, None)]), now(), True, ["@spam"])
    return services.skip_counts(tagged).unionByName(services.kept_posts(tagged).agg(F.lit("kept").alias("skipped"), F.count("*").alias("n")))


VIDEOS = '{"data": [{"aweme_info": {"aweme_id": "v1", "desc": "@某人创作的原声", "title": "AI 视频", "author": {"nickname": "老王"}, "create_time": 1784887200, "statistics": {"digg_count": "1,200", "comment_count": 3}, "music": {"title": "sound", "id": 4}}}, {"aweme_info": {"aweme_id": "v1", "desc": "again"}}]}'
NOTES = '{"items": [{"note_card": {"note_id": "6a633f20aaaa", "display_title": "笔记", "user": {"nickname": "小红"}, "interact_info": {"liked_count": "12"}, "xsec_token": "t"}}, {"note_card": {"note_id": "n2", "title": "二", "time": 1784887200000}}]}'
POST_ROWS = [("v1", "老王", "AI 视频", "https://www.douyin.com/video/v1", AT, 1200, 3), ("6a633f20aaaa", "小红", "笔记", "https://www.xiaohongshu.com/explore/6a633f20aaaa?xsec_token=t", dt.datetime(2026, 7, 24, 10, 32), 12, 0), ("n2", "Xiaohongshu Search", "二", "https://www.xiaohongshu.com/explore/n2", AT, 0, 0)]


@registered(values("post_id VARCHAR, source VARCHAR, title VARCHAR, url VARCHAR, published TIMESTAMP, likes BIGINT, comments BIGINT", POST_ROWS))
def creator_searches(spark, d):
    of = lambda p: literal(spark, "payload VARCHAR", [(p,), (None,), ("{",)])
    both = services.creator_posts(of(VIDEOS), "tikhub_douyin", now()).unionByName(services.creator_posts(of(NOTES), "tikhub_xiaohongshu", now()))
    return both.select("post_id", "source", "title", "url", F.date_trunc("minute", "published").alias("published"), "creator_metrics.likes", "creator_metrics.comments")


STATE = [("x_api", "2026-07-23 10:00:00", True, 5, "2026-07-23 10:00:00", None), ("tikhub", "2026-07-20 10:00:00", True, 1, "2026-07-20 10:00:00", None), ("idle", "2026-07-01 00:00:00", False, 0, None, "Timeout")]
_STATE = "source VARCHAR, last_run_at TIMESTAMP, last_ok BOOLEAN, last_item_count BIGINT, last_success_at TIMESTAMP, last_error VARCHAR"
STATE_ROWS = [("x_api", NOW, True, 9, NOW, None), ("tikhub", NOW, False, 0, dt.datetime(2026, 7, 20, 10), "HTTPError"), ("idle", dt.datetime(2026, 7, 1), False, 0, None, "Timeout"), ("socialdata", NOW, True, 2, NOW, None)]


@registered(values(_STATE, STATE_ROWS))
def run_state(spark, d):
    state = spark.createDataFrame(STATE, "source string, a string, last_ok boolean, last_item_count long, b string, last_error string").select("source", F.col("a").cast("timestamp").alias("last_run_at"), "last_ok", "last_item_count", F.col("b").cast("timestamp").alias("last_success_at"), "last_error")
    tried = spark.createDataFrame([("x_api", True, True, 9, None), ("tikhub", True, False, None, "HTTPError"), ("idle", False, None, None, None), ("socialdata", True, True, 2, None)], "source string, attempted boolean, ok boolean, item_count long, error string")
    return gates.updated_state(state, tried, now())


RUNS = [(1, None, True, None, False, None), (2, "off", True, None, False, None), (3, None, False, None, True, None), (4, None, True, 0, True, None), (5, None, True, None, True, 1784887200), (6, "yes", True, None, False, 1784887200)]


@registered(values("id BIGINT, enabled BOOLEAN, run BOOLEAN, reason VARCHAR, cap INT, max_cost DOUBLE", [(1, True, False, "outside_initial_window", 20, 0.004), (2, False, False, "disabled", 20, 0.004), (3, False, False, "no_credentials", 20, 0.004), (4, True, False, "cap_too_small", 0, 0.0), (5, True, True, None, 20, 0.004), (6, True, False, "before_run_interval", 20, 0.004)]))
def metered_runs(spark, d):
    r = spark.createDataFrame(RUNS, "id long, switch string, has_key boolean, cap int, forced boolean, last long")
    run = gates.source_run("socialdata", gates.toggle(F.col("switch"), True), F.col("has_key"), F.col("cap"), F.col("forced"), F.col("last"), F.unix_seconds(now()))
    return r.select("id", run.alias("r")).select("id", "r.*")


MAILS = [("m1", "Ann <ann@news.example.com>", " The  week ", "write to me@x.org", "2026-07-24", ["a"]), ("m2", "bob@other.org", "s", "p", "2026-07-24", None), (None, "no address", None, None, None, [])]


@registered(values("id VARCHAR, source VARCHAR, sender_domain VARCHAR, subject VARCHAR, preview VARCHAR, has_attachments BOOLEAN, attachment_count BIGINT", [("agentmail:edddfa1cb4b4", "AgentMail · news.example.com", "news.example.com", "The week", "write to [redacted-email]", True, 1)]).replace("'agentmail:edddfa1cb4b4'", "'agentmail:' || substr(sha1('m1'), 1, 12)"))
def mail_digests(spark, d):
    mails = spark.createDataFrame(MAILS, "message_id string, from string, subject string, preview string, timestamp string, attachments array<string>")
    return services.mail_digest(mails, services.allowed_domains("@Example.com, nonsense")).select("id", "source", "sender_domain", "subject", "preview", "has_attachments", "attachment_count")


BLOCKS_TREE = [("h2", "root", "heading2", "2026 年 7 月"), ("h3", "h2", "heading3", "7 月 22 日"), ("b1", "h3", "bullet", "新增  《》工具"), ("b2", "b1", "text", "深一层"), ("h3b", "h2", "heading3", "8月30日"), ("b3", "h3b", "bullet", "去年的"), ("b4", "root", "bullet", "undated"), ("b5", "h3", "bullet", "新增 工具"), ("hx", "h2", "heading3", "2月30日"), ("b6", "hx", "bullet", "no date")]


@registered(values("date DATE, title VARCHAR, latest BOOLEAN", [("2026-07-22", "新增 工具", True), ("2026-07-22", "深一层", True)]))
def wiki_updates(spark, d):
    blocks = literal(spark, "id VARCHAR, parent_id VARCHAR, type VARCHAR, text VARCHAR", BLOCKS_TREE)
    today = F.lit("2026-07-24").cast("date")
    found = payloads.block_updates(blocks, today)
    return payloads.recent_updates([found, found], today)


STATUS = [("a", True, 5, False, False), ("b", False, 0, False, False), ("c", True, 0, False, False), ("d", True, 0, True, False), ("e", True, 0, False, True)]
FEED_STATUS = [("f1", True, 3, False, False), ("f2", False, None, False, False), ("f3", True, 0, False, True), ("f4", None, None, True, False)]


@registered(values("sources BIGINT, successful BIGINT, failed_sites VARCHAR[], zero_item_sites VARCHAR[], empty_advanced VARCHAR[], items BIGINT, feeds BIGINT, ok_feeds BIGINT, failed_feeds VARCHAR[], zero_item_feeds VARCHAR[], skipped_feeds BIGINT, replaced_feeds BIGINT, failures INT", [(5, 4, ["b"], ["c"], ["e"], 5, 4, 2, ["f2"], ["f3"], 1, 1, 2)]))
def run_health(spark, d):
    return query.source_health(literal(spark, "site_id VARCHAR, ok BOOLEAN, item_count BIGINT, skipped BOOLEAN, advanced BOOLEAN", STATUS), literal(spark, "feed_url VARCHAR, ok BOOLEAN, item_count BIGINT, skipped BOOLEAN, replaced BOOLEAN", FEED_STATUS))


BILINGUAL = [(1, "OpenAI ships a new model today", "https://a/1", None, None, 1), (2, "OpenAI 今日发布新模型", "https://a/1?utm_source=x", None, None, 2), (3, "Cached English title of the day", "https://a/3", None, None, 3), (4, "Lonely English title of the day", "https://a/4", None, None, 4), (5, "中文题", "https://a/5", None, "Provided English title here", 5), (6, "x", "https://a/6", "给的题", "Given English title here", 6), (7, "42", None, None, "42", 7)]
BILINGUAL_ROWS = [
    (1, "OpenAI ships a new model today", "OpenAI ships a new model today", "OpenAI 今日发布新模型", "OpenAI 今日发布新模型 / OpenAI ships a new model today"),
    (2, "OpenAI 今日发布新模型", None, "OpenAI 今日发布新模型", "OpenAI 今日发布新模型"),
    (3, "Cached English title of the day", "Cached English title of the day", "存下的题", "存下的题 / Cached English title of the day"),
    (4, "Lonely English title of the day", "Lonely English title of the day", None, "Lonely English title of the day"),
    (5, "Provided English title here", "Provided English title here", "中文题", "中文题 / Provided English title here"),
    (6, "Given English title here", "Given English title here", "给的题", "给的题 / Given English title here"),
    (7, "42", None, None, "42"),
]


@registered(values("id BIGINT, title_original VARCHAR, title_en VARCHAR, title_zh VARCHAR, title_bilingual VARCHAR", BILINGUAL_ROWS))
def bilingual_titles(spark, d):
    items = literal(spark, "id BIGINT, title VARCHAR, url VARCHAR, provided_title_zh VARCHAR, provided_title_en VARCHAR, ingest_seq BIGINT", BILINGUAL)
    cache = literal(spark, "title VARCHAR, title_zh VARCHAR", [("Cached English title of the day", "存下的题"), ("other", " ")])
    return payloads.bilingual(items, items, cache).select("id", "title_original", "title_en", "title_zh", "title_bilingual")


_CREATORS = [("p1", "tikhub_douyin", "老王", "OpenAI 发布 新模型 视频", "https://d/1", 2, 1000, 10), ("p2", "tikhub_douyin", "老王", "OpenAI 发布 新模型 视频", "https://d/1", 3, 1000, 10), ("p3", "tikhub_xiaohongshu", "小红", "Claude 编程 笔记", "https://x/1", 30, 1000, 10), ("p4", "tikhub_douyin", "老李", "美食 旅游", "https://d/4", 1, 10**6, 0), ("p5", "tikhub_douyin", "老李", "OpenAI 旧闻", "https://d/5", 300, 5, 0), ("p6", "aibase", "AIbase", "OpenAI", "https://d/6", 1, 5, 0)]


@registered(values("id VARCHAR, engagement DOUBLE, heat DOUBLE, bonus DOUBLE, hot DOUBLE", [("p1", 1020.0, 60.2, 15.0, 66.2), ("p3", 1020.0, 66.2, 0.0, 56.3)]))
def creators_hot(spark, d):
    rows = spark.createDataFrame([(i, s, s, n, t, u, h, k, c) for i, s, n, t, u, h, k, c in _CREATORS], "id string, site_id string, site_name string, source string, title string, url string, h int, likes long, comments long")
    at = now() - F.make_dt_interval(hours=F.col("h"))
    metrics = F.struct("likes", "comments", F.lit(0).cast("long").alias("collects"), F.lit(0).cast("long").alias("shares"))
    archive = rows.select("id", "site_id", "site_name", "source", "title", "url", F.lit(None).cast("string").alias("summary"), at.alias("published_at"), at.alias("first_seen_at"), metrics.alias("creator_metrics"))
    hot = payloads.creator_hot(archive, now(), True)
    return hot.select("id", F.col("creator_engagement_total").alias("engagement"), F.col("creator_heat_score").alias("heat"), F.col("creator_freshness_bonus").alias("bonus"), F.col("creator_hot_score").alias("hot"))


def news_items(spark: SparkSession) -> DataFrame:
    """The literal items as the archive has them, an hour apart, bilingual and shown."""
    rows = literal(spark, _COLUMNS, [r for r in ITEMS + MERGING if r[1]])
    at = now() - F.make_dt_interval(mins=(F.lit(200) - F.col("id")) * 5)
    archive = rows.select("*", at.alias("published_at"), at.alias("first_seen_at"), *[F.lit(None).cast("string").alias(c) for c in ("provided_title_zh", "provided_title_en", "aihot_score")], F.col("id").alias("ingest_seq"))
    none = literal(spark, "title VARCHAR, title_zh VARCHAR", [])
    return payloads.bilingual(payloads.shown(archive, now()), archive, none)


MERGING = [
    (101, "official_ai", "Official AI Updates", "OpenAI News", "OpenAI launches the GPT-6 model for all developers", None, "https://openai.com/m1"),
    (102, "aibase", "AIbase", "AIbase", "OpenAI launches the GPT-6 model for all developers!", None, "https://www.aibase.com/m2"),
    (103, "iris", "Info Flow", "flow", "OpenAI launches the GPT-5 model for all developers", None, "https://b.example/m3"),
    (104, "iris", "Info Flow", "flow", "Google launches the GPT-6 model for all developers", None, "https://b.example/m4"),
    (105, "newsnow", "NewsNow", "News", "A different headline that links the same page", None, "https://openai.com/m1?ref=x"),
    (106, "kr36_ai", "36Kr", "36Kr", "OpenAI launches the GPT-6 model for all developers", None, "https://36kr.example/m6"),
    (107, "newsnow", "NewsNow", "News", "short one", None, "https://d.example/m7"),
    (108, "iris", "Info Flow", "flow", "short one", None, "https://b.example/m8"),
]


@registered(values("title VARCHAR, item_count BIGINT, duplicate_count BIGINT, category VARCHAR, business_events VARCHAR[], reasons VARCHAR[]", [("OpenAI launches the GPT-6 model for all developers", 4, 3, "official", ["model_release"], ["official_source", "multi_source", "high_importance"])]))
def news_stories(spark, d):
    stories, _ = payloads.merged_stories(news_items(spark), now())
    return stories.where("item_count > 1").select("title", "item_count", "duplicate_count", "category", "business_events", F.filter("reasons", lambda r: r != "high_ai_relevance").alias("reasons"))


@registered(values("item_id BIGINT, reason VARCHAR, similarity DOUBLE", [(102, "title_similarity", 0.9941), (105, "canonical_url", 1.0), (106, "title_similarity", 1.0)]))
def news_merge_log(spark, d):
    _, merged = payloads.merged_stories(news_items(spark), now())
    return merged.select("item_id", "reason", "similarity")


@registered(values("title VARCHAR, place INT", [("OpenAI launches the GPT-6 model for all developers", 1), ("OpenAI releases GPT-6 model for developers", 2)]))
def news_brief(spark, d):
    stories, _ = payloads.merged_stories(news_items(spark), now())
    return payloads.daily_brief(stories).where("place <= 2").select("title", "place")
