"""Parsers of hosted payloads (JSON services, newsletters, builder feeds) and the rules that resolve feed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.items import first_non_empty
from tidewire.functions.text import fix_mojibake, has_word
from tidewire.functions.urls import normalize_url

# Feeds that moved, and feeds that can't be read.
MOVED = {
    "https://rsshub.app/infoq/recommend": "https://www.infoq.cn/feed",
    "https://rsshub.app/huggingface/blog-zh": "https://huggingface.co/blog/feed.xml",
    "https://rsshub.app/readhub/daily": "https://readhub.cn/rss",
    "https://rsshub.app/36kr/hot-list": "https://36kr.com/feed",
    "https://rsshub.app/sspai/index": "https://sspai.com/feed",
    "https://rsshub.app/sspai/matrix": "https://sspai.com/feed",
    "https://rsshub.app/meituan/tech": "https://tech.meituan.com/feed",
    "https://mjg59.dreamwidth.org/data/rss": "http://mjg59.dreamwidth.org/data/rss",
}
UNREADABLE = ["https://rachelbythebay.com/w/atom.xml", "https://flak.tedunangst.com/rss"]
UNSERVED = ["https://rsshub.app/telegram/channel/", "https://rsshub.app/jike/", "https://rsshub.app/bilibili/", "https://rsshub.app/zhihu/", "https://rsshub.app/xiaoyuzhou/podcast/", "https://rsshub.app/xyzrank", "https://rsshub.app/mittrchina/hot", "https://wechat2rss.bestblogs.dev/", "https://werss.bestblogs.dev/", "http://47.122.94.119:18080/"]
# The least score of a scored service's item; the size of a post's title.
LEAST_SCORE, POST_TITLE = 60, 220

SCORED_ITEMS = "struct<items: array<struct<id: string, score: string, title: string, title_en: string, url: string, publishedAt: string, source: string, category: string, selected: boolean, summary: string>>>"
BUILDERS = "struct<x: array<struct<name: string, handle: string, tweets: array<struct<text: string, url: string, createdAt: string>>>>, blogs: array<struct<name: string, title: string, url: string, publishedAt: string>>, podcasts: array<struct<name: string, title: string, url: string, publishedAt: string>>, generatedAt: string>"
JSON_FEED = "struct<items: array<struct<title: string, url: string, date_published: string, date_modified: string>>>"


def resolved_feed(url: Column) -> Column:
    """struct(url, reason): the address to read a feed at, null with a reason if it can't be read."""
    said = lambda to, why: F.struct(to.cast("string").alias("url"), F.lit(why).cast("string").alias("reason"))
    src, none = F.trim(F.coalesce(url, F.lit(""))), F.lit(None)
    unserved = F.exists(F.array(*map(F.lit, UNSERVED)), lambda p: F.startswith(src, p))
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in MOVED.items() for x in pair]), src)
    return F.when(src == "", said(none, "empty_url")).when(src.isin(UNREADABLE), said(none, "no_official_rss_or_unreachable")).when(unserved, said(none, "no_official_rss_for_source_type")).when(moved.isNotNull(), said(moved, "official_replacement")).otherwise(said(src, None))


def public_page(feed_url: Column, html_url: Column) -> Column:
    """struct(kind, slug, url): the public page that stands for a bridge's feed, else null."""
    feed, page = F.trim(F.coalesce(feed_url, F.lit(""))), F.trim(F.coalesce(html_url, F.lit("")))
    part = lambda kind: F.regexp_extract(feed, rf"^[a-z]+://rsshub\.app/{kind}/+([^/?#]+)", 1)
    last = F.element_at(F.split(F.rtrim(page, F.lit("/")), "/"), -1)
    places = [("telegram", "telegram/+channel", "https://t.me/s/"), ("jike_topic", "jike/+topic", "https://m.okjike.com/topics/"), ("jike_user", "jike/+user", "https://m.okjike.com/users/")]
    made = lambda kind, slug, url: F.struct(F.lit(kind).alias("kind"), slug.alias("slug"), url.alias("url"))
    bridges = [F.when(part(path) != "", made(kind, part(path), F.concat(F.lit(at), part(path)))) for kind, path, at in places]
    pages = [F.when(page.startswith(at), made(kind, last, page)) for kind, _, at in places]
    return F.coalesce(*bridges, *pages)


def scored_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Items of a scored JSON service with at least ``LEAST_SCORE`` (numbers only), each normalised URL once, the first."""
    rows = payloads.select(F.posexplode(F.from_json(column, SCORED_ITEMS)["items"]).alias("pos", "i")).select("pos", "i.*")
    score = F.col("score").try_cast("double")
    title, link = fix_mojibake(first_non_empty(F.col("title"), F.col("title_en"))), F.trim("url")
    kept = rows.select("pos", "id", score.alias("score"), title.alias("title"), link.alias("url"), normalize_url(link).alias("_key"), F.col("publishedAt").alias("published"), fix_mojibake(F.coalesce(first_non_empty(F.col("source")), F.lit("AI HOT"))).alias("source"), "category", F.coalesce("selected", F.lit(False)).alias("selected"), "summary")
    kept = kept.where((F.col("score") >= LEAST_SCORE) & F.col("title").isNotNull() & (F.col("url") != ""))
    rest = [c for c in kept.columns if c not in ("_key", "pos")]
    return kept.groupBy("_key").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("r.*")


def post_title(text: Column) -> Column:
    """A post's text on one line, of at most ``POST_TITLE`` characters."""
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.length(flat) > POST_TITLE, F.concat(F.rtrim(F.substring(flat, 1, POST_TITLE - 3)), F.lit("..."))).otherwise(flat)


def builder_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(source, title, url, published) of posts, blogs and podcasts in nested feeds; what lacks one of these goes, but
    blogs and podcasts without a date take the feed's."""
    doc = payloads.select(F.from_json(column, BUILDERS).alias("d"))
    who = F.coalesce(first_non_empty(F.col("b.name"), F.col("b.handle")), F.lit(""))
    posts = doc.select(F.explode("d.x").alias("b")).select(F.rtrim(F.concat(F.lit("Follow Builders · X · "), who), F.lit(" ·")).alias("source"), F.explode("b.tweets").alias("t"))
    parts = [posts.select("source", post_title(F.col("t.text")).alias("title"), F.trim("t.url").alias("url"), F.col("t.createdAt").alias("published"))]
    for kind, field in (("Blog", "d.blogs"), ("Podcast", "d.podcasts")):
        one = doc.select(F.col("d.generatedAt").alias("made"), F.explode(field).alias("e"))
        parts.append(one.select(F.concat(F.lit(f"Follow Builders · {kind} · "), F.coalesce(first_non_empty(F.col("e.name")), F.lit(kind))).alias("source"), F.trim("e.title").alias("title"), F.trim("e.url").alias("url"), F.coalesce("e.publishedAt", "made").alias("published")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.where("title != '' and url != '' and published is not null").withColumn("title", fix_mojibake(F.col("title")))


def newsletter_items(payloads: DataFrame, now: Column, column: str = "payload", max_days: int = 45) -> DataFrame:
    """(title, url, published) of a newsletter's archive page as Markdown, each URL once, up to ``max_days`` old."""
    entry = r"([A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})\s+•\s+\d+\s+min read\s+###\s+\*\*(.*?)\*\*.*?\]\((https?://aibreakfast\.beehiiv\.com/p/[^)]+)\)"
    found = payloads.select(F.posexplode(F.regexp_extract_all(column, F.lit(f"(?s)({entry})"), 1)).alias("pos", "e"))
    part = lambda i: F.regexp_extract("e", f"(?s){entry}", i)
    day = F.try_to_timestamp(F.regexp_replace(part(1), r"\s+", " "), F.lit("MMM d, yyyy"))
    rows = found.select("pos", fix_mojibake(F.trim(F.regexp_replace(part(2), r"\s+", " "))).alias("title"), F.trim(part(3)).alias("url"), day.alias("published"))
    recent = rows.where(F.col("published") >= now - F.make_dt_interval(days=F.lit(max_days)))
    return recent.groupBy("url").agg(F.min_by(F.struct("title", "published"), "pos").alias("r")).select("url", "r.*")


def allowed_entry(title: Column, link: Column, feed_title: Column, keywords: list[str], strict: bool = False) -> Column:
    """Whether a feed's entry holds one of its keywords ('ai' only as a word); no keywords allow all."""
    if not keywords:
        return F.lit(True)
    text = F.lower(F.coalesce(title, F.lit("")) if strict else F.concat_ws(" ", title, link, feed_title))
    return F.coalesce(*[F.when(has_word(text, [k]) if k == "ai" else F.contains(text, F.lit(k)), True) for k in (w.lower() for w in keywords)], F.lit(False))


def latest_entries(entries: DataFrame, now: Column, max_days: int, first: int | None = None) -> DataFrame:
    """Entries (feed, pos, link, published timestamp) that are dated and recent, each link once a feed, and of those
    the ``first`` in feed order."""
    from tidewire.operators.rank import best_per_key, first_by

    recent = entries.where(F.col("published") >= now - F.make_dt_interval(days=F.lit(max_days)))
    once = best_per_key(recent, ["feed", "link"], F.struct("pos"))
    return once if first is None else first_by(once, ["feed"], [F.col("pos")], first)
