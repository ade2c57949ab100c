"""Derived columns of items: event keys, source types, categories, contacts, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import has_word, title_tokens
from tidewire.plans.dims import BRIEF_AT

# Marks that an event key ignores, and product names that make a key of their own.
MARKS = r"[，。、“”‘’：:；;！!？?（）()\[\]【】《》<>·.,/\\|_-]"
PRODUCTS = r"(bitcpmcann|deepseekv\d+(?:pro)?|grokv\d+(?:medium)?|gemini\d+(?:\.\d+)?(?:flash|pro)?|gpt\d+(?:\.\d+)?|llama\d+)"
# Source types, by site and by tier.
SOURCE_TYPES = [
    ("official", ["official_ai"], ["official"]),
    ("media", ["curated_media", "aibreakfast", "aihot"], []),
    ("rss", ["opmlrss"], ["user_opml"]),
    ("community", ["waytoagi", "followbuilders", "hackernews", "zeli", "aibase"], []),
    ("advanced", ["socialdata_x", "xapi", "agentmail"], []),
]


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def event_text(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s　]+", ""), MARKS, "")


def event_key(title: Column) -> Column:
    """What names an item's event: a title in book marks, else a known product, else the head of the plain title."""
    book, plain = F.regexp_extract(F.coalesce(title, F.lit("")), "《([^》]{4,40})》", 1), event_text(title)
    product = F.regexp_extract(plain, PRODUCTS, 1)
    return (
        F.when(book != "", F.concat(F.lit("book:"), F.substring(event_text(book), 1, 36)))
        .when(product != "", F.concat(F.lit("entity:"), product))
        .otherwise(F.concat(F.lit("title:"), F.substring(plain, 1, 34)))
    )


def source_type(site: Column, tier: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, sites, tiers in SOURCE_TYPES:
        out = out.when(F.coalesce(site.isin(sites), F.lit(False)) | F.coalesce(tier.isin(tiers), F.lit(False)), name)
    return out.otherwise("aggregate")


def is_mergeable(title: Column) -> Column:
    return (F.size(title_tokens(title)) >= 4) & (F.length(F.trim(title)) >= 18)


def keyword_score(title: Column, terms: list[str], enough: int = 3) -> Column:
    hits = sum((F.coalesce(has_word(title, [t]), F.lit(False)).cast("int") for t in terms), F.lit(0))
    return F.least(F.lit(1.0), hits / enough)


def mail_domain(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", 1)), F.lit(""))


def in_domains(domain: Column, allowed: list[str]) -> Column:
    """Whether a domain is an allowed one or below it; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    return F.coalesce(F.exists(F.array(*map(F.lit, allowed)), lambda a: (domain == a) | F.endswith(domain, F.concat(F.lit("."), a))), F.lit(False))


def metric_count(*values: Column) -> Column:
    """The first value that reads as a number (commas ignored), as a whole number of at least 0; else 0."""
    read = [F.regexp_replace(F.trim(v.cast("string")), ",", "").try_cast("double") for v in values]
    return F.greatest(F.lit(0), F.coalesce(*read, F.lit(0.0)).cast("long"))


def id_time(note_id: Column, now: Column) -> Column:
    """The time in an id's first 8 hexadecimal digits, if it lies between 2013 and now."""
    digits = F.nullif(F.regexp_extract(F.trim(note_id), "^([0-9a-fA-F]{8})", 1), F.lit(""))
    at = F.timestamp_seconds(F.conv(digits, 16, 10).cast("long"))
    return F.when((F.unix_seconds(at) >= 1356998400) & (at <= now), at)


def category(score: Column, tier: Column, duplicates: Column) -> Column:
    return F.when(tier == "official", "official").when(duplicates >= 3, "multi_source").when(score >= BRIEF_AT, "industry").otherwise("watch")


def reasons(score: Column, tier: Column, duplicates: Column, relevance: Column) -> Column:
    all_ = F.array_compact(F.array(F.when(tier == "official", "official_source"), F.when(duplicates >= 2, "multi_source"), F.when(relevance >= 0.8, "high_ai_relevance"), F.when(score >= 0.75, "high_importance")))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("recent_ai_signal")))


def staleness(age_hours: Column) -> Column:
    return F.when(age_hours < 2, "fresh").when(age_hours < 6, "warn").otherwise("bad")


def year_of_date(month: Column, day: Column, today: Column) -> Column:
    """Like ``year_of``, and this year for what is no date."""
    this = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(today), month, day), "yyyy-MM-dd")
    return F.when(this > F.date_add(today, 2), F.year(today) - 1).otherwise(F.year(today))


def year_of(month: Column, day: Column, today: Column) -> Column:
    """The year a month and day without year mean: this one, or the last if the date lies over two days ahead."""
    this = F.make_date(F.year(today), month, day)
    return F.when(this > F.date_add(today, 2), F.year(today) - 1).otherwise(F.year(today))
