"""Item pages: a table of rules says where a page's rows, links, titles and times stand; one kernel reads them all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import times
from tidewire.functions.scan import embedded_values
from tidewire.functions.text import compact_title, fix_mojibake
from tidewire.operators.rank import best_per_key
from tidewire.sources.dom import Node, parsed


@dataclass(frozen=True)
class PageRule:
    """``row`` selects the rows, inside ``block`` if given; every other selector is looked up in the row ("" is the row
    itself, the first that has text counts), ``source`` in the block. ``base`` + the link attribute is the address."""

    site_id: str
    site_name: str
    row: str
    title: tuple[str, ...]
    link: tuple[str, str] = ("", "href")
    base: str = ""
    time: tuple[tuple[str, str], ...] = ()
    block: str | None = None
    source: tuple[str, ...] = ()
    named: str | None = None
    max_days: int | None = None
    dated: bool = False
    least_title: int = 1
    not_titles: tuple[str, ...] = ()
    compact: bool = False
    once: bool = True


# The pages that are read, their selectors and limits.
PAGES = {
    "anthropic_news": PageRule("official_ai", "Official AI Updates", 'a[href^="/news/"]', ("h1", "h2", "h3", "h4"), base="https://www.anthropic.com", time=(("time", "datetime"), ("time", "")), named="Anthropic News", max_days=45, dated=True, not_titles=("news",)),
    "codex_changelog": PageRule("official_ai", "Official AI Updates", "li[id]", ("h3",), link=("", "id"), base="https://developers.openai.com/codex/changelog#", time=(("time", "datetime"), ("time", "")), named="OpenAI Codex Changelog", max_days=45, dated=True),
    "aibase": PageRule("aibase", "AIbase", 'a[href^="/news/"]', ("h3",), base="https://www.aibase.com", time=(("div.text-sm.text-gray-400 span", ""),), named="AIbase", once=False),
    "techurls": PageRule("techurls", "TechURLs", "div.publisher-link", ("a.article-link",), link=("a.article-link", "href"), time=((".aside .text", "title"), (".aside .text", "")), block="div.publisher-block", source=(".publisher-text .primary", ".publisher-text .secondary"), once=False),
    "tophub": PageRule("tophub", "TopHub", ".cc-cd-cb-l a", (".cc-cd-cb-ll .t", ""), base="https://tophub.today", time=((".cc-cd-cb-ll", ""),), block=".cc-cd", source=(".cc-cd-lb span", ".cc-cd-sb-st"), once=False),
    "newsletters": PageRule("bestblogs", "BestBlogs", 'a[href*="/newsletter"]', ("",), base="https://www.bestblogs.dev", time=(("time", "datetime"), ("time", "")), named="Weekly Newsletter", least_title=8),
    "telegram": PageRule("opmlrss", "OPML RSS", ".tgme_widget_message[data-post]", (".tgme_widget_message_text", ".tgme_widget_message_link_preview_title"), link=("", "data-post"), base="https://t.me/", time=(("time[datetime]", "datetime"),), dated=True, compact=True, once=False),
}


def rows_of(html: str, rule: PageRule) -> list[tuple[int, str, str, str, str]]:
    """(pos, source, title, link, said) of a page's rows."""

    def found(node: Node, selector: str) -> Node | None:
        return node.first(selector) if selector else node

    def value(node: Node, selector: str, attr: str) -> str:
        at = found(node, selector)
        return "" if at is None else (at.attrs.get(attr, "") if attr else at.text()).strip()

    root, out = parsed(html), []
    for block in root.all(rule.block) if rule.block else [root]:
        names = [value(block, s, "") for s in rule.source]
        source = " · ".join(dict.fromkeys(n for n in names if n)) or block.attrs.get("data-publisher", "") or rule.named or rule.site_name
        for row in block.all(rule.row):
            title = next((t for t in (value(row, s, "") for s in rule.title) if t), "")
            said = next((t for t in (value(row, s, a) for s, a in rule.time) if t), "")
            out.append((len(out), source, title, value(row, *rule.link), said))
    return out


def page_rows(payloads: DataFrame, rule: PageRule, now: Column, column: str = "payload") -> DataFrame:
    """(site_id, site_name, source, title, url, published) of stored pages (``column``: their HTML).

    Rows without title or link go; relative links are completed; each link counts once a page, the first, where the rule
    says so; undated rows go where it asks for dates, and rows older than its limit. A page that can't be read gives no
    rows. Extra columns are not read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(n, *r) for n, html in zip(part.page, part.html) for r in rows_of(html or "", rule)]
            yield pd.DataFrame(rows, columns=["page", "pos", "source", "title", "link", "said"])

    pages = payloads.select(F.monotonically_increasing_id().alias("page"), F.col(column).alias("html"))
    raw = pages.mapInPandas(run, "page long, pos int, source string, title string, link string, said string")
    link = F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(rule.base), "link"))
    title = fix_mojibake(F.col("title"))
    rows = raw.where("link != ''").select("page", "pos", fix_mojibake(F.col("source")).alias("source"), (compact_title(title) if rule.compact else title).alias("title"), link.alias("url"), times.parse_any(F.col("said"), now).alias("published"))
    rows = rows.where((F.length("title") >= rule.least_title) & ~F.lower("title").isin(["?", *rule.not_titles]))
    if rule.dated:
        rows = rows.where("published is not null")
    if rule.max_days:
        rows = rows.where(F.col("published").isNull() | (F.col("published") >= now - F.make_dt_interval(days=F.lit(rule.max_days))))
    if rule.once:
        rows = best_per_key(rows, ["page", "url"], F.struct("pos"))
    return rows.select(F.lit(rule.site_id).alias("site_id"), F.lit(rule.site_name).alias("site_name"), "source", "title", "url", "published")


def embedded_posts(payloads: DataFrame, source: Column, now: Column, column: str = "payload") -> DataFrame:
    """Posts in the JSON that a rendered page carries in its script tag; undated and empty ones go."""
    script = F.regexp_extract(column, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    posts = F.from_json(script, "struct<props: struct<pageProps: struct<posts: array<struct<id: string, content: string, createdAt: string, actionTime: string>>>>>")["props"]["pageProps"]["posts"]
    rows = payloads.select(source.alias("source"), F.explode(posts).alias("p"))
    at = F.coalesce(times.parse_any(F.col("p.createdAt"), now), times.parse_any(F.col("p.actionTime"), now))
    made = rows.select(F.lit("opmlrss").alias("site_id"), F.lit("OPML RSS").alias("site_name"), "source", compact_title(F.col("p.content")).alias("title"), F.concat(F.lit("https://m.okjike.com/originalPosts/"), F.trim("p.id")).alias("url"), at.alias("published"), F.trim("p.id").alias("id"))
    return made.where("id != '' and title != '' and published is not null").drop("id")


def listed_feeds(pages: DataFrame, column: str = "payload") -> DataFrame:
    """The other columns of pages with (name, url) of each feed that their scripts list."""
    section = F.regexp_extract(column, r"(?s)const\s+feeds\s*=\s*\[(.*?)\]\s*;", 1)
    entry = r"(?s)(\{\s*name:\s*'[^']+'\s*,\s*url:\s*'[^']+'\s*\})"
    part = lambda n: F.regexp_extract("e", rf"{n}:\s*'([^']+)'", 1)
    others = [c for c in pages.columns if c != column]
    return pages.select(*others, F.explode(F.regexp_extract_all(section, F.lit(entry), 1)).alias("e")).select(*others, part("name").alias("name"), part("url").alias("url"))


# Keys of a bundle's source table that are no sources, and the sources when there is no table.
NO_SOURCES = ["name", "column", "home", "https", "color", "interval", "title", "type", "redirect", "desc"]
FALLBACK_SOURCES = ["hackernews", "producthunt", "github", "sspai", "juejin", "36kr"]


def bundled_sources(bundles: DataFrame, column: str = "payload") -> DataFrame:
    """The other columns of script bundles with (pos, source_id): the keys of a bundle's source table, else the known
    sources."""
    held = F.get(embedded_values(F.col(column), r"(?=\{v2ex:vL)"), F.lit(0))
    # Keys lose their quotes first, so that what is still quoted is a value and doesn't count.
    bare = F.regexp_replace(F.regexp_replace("_t", r'"([a-zA-Z0-9_-]+)"\s*:', "$1:"), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')
    keys = F.regexp_extract_all(bare, F.lit(r"""(["']?)([a-zA-Z0-9_-]+)\1\s*:"""), 2)
    known = F.filter(F.array_distinct(keys), lambda k: ~k.isin(NO_SOURCES))
    ids = F.when(F.col("_t").isNotNull(), known).otherwise(F.array(*map(F.lit, FALLBACK_SOURCES)))
    return bundles.withColumn("_t", held).select(*[c for c in bundles.columns if c != column], F.posexplode(ids).alias("pos", "source_id"))
