"""Parsers over stored payload rows: feeds, subscription lists, search hits and pages become item rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import times, urls
from tidewire.functions.items import keyword_score
from tidewire.functions.text import fix_mojibake, has_word
from tidewire.operators.graph import settled
from tidewire.operators.rank import best_per_key


def unescaped(text: Column) -> Column:
    """Text of a feed with its entities read: numbers, the five of XML, and the space; the ampersand last."""
    decimal = F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), 1)
    hexa = F.regexp_extract_all(text, F.lit("&#[xX]([0-9a-fA-F]{1,6});"), 1)
    point = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.reduce(F.array_distinct(decimal), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), point(n.cast("long"))))
    out = F.reduce(F.array_distinct(hexa), out, lambda t, n: F.replace(F.replace(t, F.concat(F.lit("&#x"), n, F.lit(";")), point(F.conv(n, 16, 10).cast("long"))), F.concat(F.lit("&#X"), n, F.lit(";")), point(F.conv(n, 16, 10).cast("long"))))
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(mark))
    return out


_RSS_ITEM = "struct<title: string, link: array<string>, pubDate: string, published: string, updated: string, date: string>"
_ATOM_ENTRY = "struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string>"
#: RSS has its items in the channel, RDF beside it, Atom has entries.
FEED = f"struct<channel: struct<item: array<{_RSS_ITEM}>>, item: array<{_RSS_ITEM}>, entry: array<{_ATOM_ENTRY}>, _bad: string>"
_XML = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_bad"}


def read_feeds(payloads: DataFrame, xml: str = "payload") -> DataFrame:
    """The payload columns without ``xml``, ``entries`` (array of title, link, published) and ``error``.

    A payload that is no well-formed XML is read again with entities of HTML and bare ampersands mended; what is still
    broken has a null list and the error "unreadable", and one without any entry the error "no entries". Null payloads
    have the error "missing".
    """
    mended = F.regexp_replace(F.replace(F.col(xml), F.lit("&nbsp;"), F.lit("&#160;")), r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});)", "&amp;")
    once = payloads.withColumn("_f", F.from_xml(xml, FEED, _XML))
    bad = F.col("_f._bad").isNotNull()
    again = once.withColumn("_g", F.when(bad, F.from_xml(F.when(bad, mended), FEED, _XML)).otherwise(F.col("_f")))
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    none = F.array().cast("array<struct<title: string, link: string, published: string>>")

    def item(x: Column) -> Column:
        return F.struct(F.coalesce(plain(x["title"]), F.lit("")).alias("title"), plain(F.get(x["link"], F.lit(0))).alias("link"), F.coalesce(*[plain(x[c]) for c in ("pubDate", "published", "updated", "date")]).alias("published"))

    def entry(x: Column) -> Column:
        main = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(F.get(main, F.lit(0))["_href"], F.get(x["link"], F.lit(0))["_href"])
        return F.struct(F.coalesce(plain(x["title"]), F.lit("")).alias("title"), plain(link).alias("link"), F.coalesce(plain(x["published"]), plain(x["updated"])).alias("published"))

    found = F.concat(F.coalesce(F.transform("_g.channel.item", item), none), F.coalesce(F.transform("_g.item", item), none), F.coalesce(F.transform("_g.entry", entry), none))
    error = F.when(F.col(xml).isNull(), "missing").when(F.col("_g._bad").isNotNull(), "unreadable").when(F.size("entries") == 0, "no entries")
    kept = [c for c in payloads.columns if c != xml]
    return again.withColumn("entries", F.when(F.col("_g._bad").isNull(), found)).select(*kept, "entries", error.alias("error"))


def feed_items(payloads: DataFrame, xml: str = "payload") -> DataFrame:
    """(payload columns, pos, title, link, published) of RSS, RDF and Atom entries; equal (title, link) of one payload once.

    Payloads that can't be read give no rows; ``read_feeds`` names them.
    """
    numbered = payloads.withColumn("_n", F.monotonically_increasing_id())
    rows = read_feeds(numbered, xml).select(*[c for c in numbered.columns if c != xml], F.posexplode("entries").alias("pos", "e")).select("*", "e.*").drop("e")
    keys = [c for c in rows.columns if c not in ("pos", "published")]
    return rows.groupBy(*keys).agg(F.min("pos").alias("pos"), F.min_by("published", "pos").alias("published")).drop("_n")


def subscriptions(payloads: DataFrame, xml: str = "payload") -> DataFrame:
    """(title, xml_url, html_url) of a subscription list's outlines, each feed URL once."""
    one = payloads.select(F.posexplode(F.regexp_extract_all(xml, F.lit(r"(<outline\s[^>]*>)"), 1)).alias("pos", "o"))
    attr = lambda n: F.nullif(unescaped(F.regexp_extract("o", rf'\s{n}="([^"]*)"', 1)), F.lit(""))
    rows = one.select("pos", F.coalesce(attr("title"), attr("text"), attr("xmlUrl")).alias("title"), attr("xmlUrl").alias("xml_url"), attr("htmlUrl").alias("html_url")).where("xml_url is not null")
    return rows.groupBy("xml_url").agg(F.min_by("title", "pos").alias("title"), F.min_by("html_url", "pos").alias("html_url"))


HITS = "struct<hits: array<struct<objectID: string, title: string, url: string, points: int, num_comments: int, created_at_i: long>>>"


# The words of a search hit's title that count, and how many of them make a full score.
HIT_TERMS = ["openai", "anthropic", "claude", "claude code", "codex", "cursor", "mcp", "gemini", "deepseek", "qwen", "llm", "gpt", "sora", "copilot", "agent", "ai coding", "benchmark", "eval", "paper", "model", "inference"]
LEAST_HIT = 0.38


def search_hits(payloads: DataFrame, column: str = "payload", terms: list[str] = HIT_TERMS, least: float = LEAST_HIT) -> DataFrame:
    """Hits of a JSON search API, each id once (the first), with enough of the terms in the title and at least 2 comments
    or 10 points, most discussed first."""
    hit = payloads.select(F.monotonically_increasing_id().alias("page"), F.posexplode(F.from_json(column, HITS)["hits"]).alias("pos", "h")).select("page", "pos", "h.*").where("objectID is not null")
    one = hit.groupBy("objectID").agg(F.min_by(F.struct("title", "url", "points", "num_comments", "created_at_i"), F.struct("page", "pos")).alias("h")).select("objectID", "h.*")
    said = F.coalesce(keyword_score(F.col("title"), terms), F.lit(0.0))
    kept = one.where(said >= least).where("num_comments >= 2 or points >= 10")
    return kept.orderBy(F.desc("num_comments"), F.desc("points"), F.desc("created_at_i"), "objectID")


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, n_links) of HTML pages."""
    title = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return pages.select("page_id", "url", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).cast("long").alias("n_links"))


def validated(raw: DataFrame) -> DataFrame:
    return raw.where((F.trim("title") != "") & F.col("url").startswith("http"))


# Titles that only point elsewhere.
POINTERS = ["原文链接", "查看详情", "点击查看", "详情"]


def is_pointer(title: Column) -> Column:
    """Whether a title only points elsewhere."""
    said = F.trim(F.coalesce(title, F.lit("")))
    return (said == "") | F.contains(said, F.lit("详情见官方介绍")) | said.isin(POINTERS)


def is_generic(title: Column) -> Column:
    """Whether a title doesn't tell its item from others of the page."""
    return is_pointer(title) | F.trim(F.coalesce(title, F.lit(""))).rlike(r"\(AI资讯\)\s*$")


CATALOGUE = "feed string, site_id string, site_name string, source string, keywords array<string>, strict boolean, max_days int, first int, dated boolean, least_title int, prefix string"


def catalogue_items(payloads: DataFrame, catalogue: DataFrame, now: Column) -> DataFrame:
    """Items (feed, pos, site_id, site_name, source, title, url, published) of stored feeds by their catalogue rows.

    ``payloads``: (feed, payload); ``catalogue``: ``CATALOGUE``, one row a feed, few enough to broadcast. An entry needs a
    title of ``least_title`` characters that is more than a pointer and an http link; a date where ``dated``, and if it
    has one, of the last ``max_days``; one of the keywords (in the title alone if ``strict``; 'ai' only as a word), if
    any are named. Of one address the first entry counts, of a feed the ``first`` ones in its order. ``prefix`` stands
    before every title.
    """
    rules = F.broadcast(catalogue)
    rows = feed_items(payloads.select("feed", "payload")).join(rules, "feed")
    title = fix_mojibake(F.col("title"))
    made = rows.select("feed", "pos", "site_id", "site_name", "source", "keywords", "strict", "max_days", "first", "dated", F.coalesce("least_title", F.lit(1)).alias("least_title"), "prefix", title.alias("title"), F.col("link").alias("url"), urls.normalize_url(F.col("link")).alias("key"), times.parse_any(F.col("published"), now).alias("published"))
    text = F.lower(F.when(F.col("strict"), F.col("title")).otherwise(F.concat_ws(" ", "title", "url", "source")))
    named = F.exists("keywords", lambda k: F.when(k == "ai", has_word(text, ["ai"])).otherwise(F.contains(text, F.lower(k))))
    allowed = F.when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0, named).otherwise(F.lit(True))
    recent = F.col("published").isNull() | F.col("max_days").isNull() | (F.col("published") >= now - F.make_dt_interval(days=F.col("max_days")))
    kept = made.where((F.length("title") >= F.col("least_title")) & ~is_pointer(F.col("title")) & F.col("url").startswith("http") & (~F.coalesce("dated", F.lit(True)) | F.col("published").isNotNull()) & recent & allowed)
    once = best_per_key(kept, ["feed", "key"], F.struct("pos"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy("pos"))).where(F.col("first").isNull() | (F.col("n") <= F.col("first")))
    shown = F.when(F.col("prefix").isNotNull() & ~F.contains("prefix", F.col("title")), F.concat_ws(" ", "prefix", "title")).when(F.col("prefix").isNotNull(), F.col("prefix")).otherwise(F.col("title"))
    return ranked.select("feed", "pos", "site_id", "site_name", "source", shown.alias("title"), "url", "published")


ITEM = ["site_id", "site_name", "source", "title", "url", "published"]


def collected(connectors: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, list[dict]]:
    """(items of all connectors with ``ingest_seq``, one status row for each): a connector that fails, or gives no
    items, doesn't stop the others; if all fail the items are an empty table.

    Each connector's items are written to the checkpoint folder; a status has site_id, ok, item_count, duration_ms and
    error. ``ingest_seq`` follows the connectors' order, then their own rows'.
    """
    spark, parts, statuses = SparkSession.active(), [], []
    for number, (name, make) in enumerate(connectors.items()):
        began, error, count = time.time(), None, 0
        try:
            rows = make()
            lacking = [F.lit(None).cast("string").alias(c) for c in ITEM if c not in rows.columns]
            rows = settled(rows.select("*", *lacking).withColumn("ingest_seq", (F.lit(number).cast("long") * (1 << 53)) + F.monotonically_increasing_id() % (1 << 53)))
            count = rows.count()
            parts.append(rows)
            error = None if count else "no items parsed"
        except Exception as failed:  # noqa: BLE001 (a broken source is a status, not a failure of the run)
            if SparkSession.getActiveSession() is None or spark.sparkContext._jsc.sc().isStopped():
                raise  # the cluster is gone, not the source
            error = type(failed).__name__
        statuses.append({"site_id": name, "ok": error is None, "item_count": count, "duration_ms": int((time.time() - began) * 1000), "error": error})
    out = spark.createDataFrame([], ", ".join(f"{c} {'timestamp' if c == 'published' else 'string'}" for c in ITEM) + ", ingest_seq long")
    for rows in parts:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out, statuses
