"""Parsers of JSON services over stored payloads: aggregators, search services, creator platforms, mail digests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import items as I
from tidewire.functions import times, urls
from tidewire.functions.text import snippet
from tidewire.operators.rank import best_per_key

# How long a post's title may be, and which kinds of posts a followed list keeps.
POST_SIZE, LIST_TYPES = 220, ["tweet", "quote"]

FEED = "struct<items: array<struct<title: string, url: string, source: string, site_name: string, channel: string, category: string, date_published: string, date_modified: string>>>"
HOT = "struct<posts: array<struct<id: string, title: string, url: string, time: string>>>"
ISSUES = "struct<data: struct<pageCount: int, dataList: array<struct<id: string, title: string, createdTimestamp: string>>>>"
BLOCK = "struct<id: string, title: string, name: string, `desc`: string, updatedTime: string, items: array<struct<title: string, url: string, pubDate: string, extra: struct<date: string>>>>"
SEARCH = "struct<data: array<struct<id: string, text: string, author_id: string, created_at: string, lang: string>>, includes: struct<users: array<struct<id: string, username: string>>>>"
POSTS = "struct<tweets: array<struct<id_str: string, id: string, full_text: string, text: string, type: string, lang: string, tweet_created_at: string, created_at: string, user: struct<screen_name: string, default_profile_image: boolean>>>>"

_given = lambda c: F.nullif(F.trim(c), F.lit(""))


def _items(rows: DataFrame, site: str, name: str, **columns: Column) -> DataFrame:
    made = rows.select(F.lit(site).alias("site_id"), F.lit(name).alias("site_name"), *[c.alias(n) for n, c in columns.items()])
    return made.where("title is not null and url is not null")


def aggregator_feed(payloads: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Items of a JSON feed; the source is the first of four names that is given, else the URL's host."""
    rows = payloads.select(F.explode(F.from_json(column, FEED)["items"]).alias("i")).select("i.*")
    source = F.coalesce(*[_given(F.col(c)) for c in ("source", "site_name", "channel", "category")], F.nullif(urls.host(F.col("url")), F.lit("")), F.lit("Buzzing"))
    at = times.parse_any(F.coalesce(_given(F.col("date_published")), F.col("date_modified")), now)
    return _items(rows, "buzzing", "Buzzing", source=source, title=_given(F.col("title")), url=_given(F.col("url")), published=at)


def hot_posts(payloads: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """The posts of a day's hot list; one without a time counts as of now."""
    rows = payloads.select(F.explode(F.from_json(column, HOT)["posts"]).alias("p")).select("p.*")
    return _items(rows, "zeli", "Zeli", source=F.lit("Hacker News · 24h最热"), title=_given(F.col("title")), url=_given(F.col("url")), published=F.coalesce(times.epoch(F.col("time").try_cast("double")), now))


def newsletter_issues(payloads: DataFrame, pages: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Issues of a paged service, each once; if it gives none, those of the stored page."""
    from tidewire.sources.pages import PAGES, page_rows

    rows = payloads.select(F.explode(F.from_json(column, ISSUES)["data"]["dataList"]).alias("i")).select("i.*")
    address = F.concat(F.lit("https://www.bestblogs.dev/en/newsletter#"), _given(F.col("id")))
    made = _items(rows, "bestblogs", "BestBlogs", source=F.lit("Weekly Newsletter"), title=_given(F.col("title")), url=address, published=times.epoch(F.col("createdTimestamp").try_cast("double")))
    once = best_per_key(made, ["url"], F.struct("title", "published")).select(*made.columns)
    some = once.limit(1).agg((F.count("*") > 0).alias("_some"))
    fallback = page_rows(pages, PAGES["newsletters"], now, column).join(F.broadcast(some)).where("not _some").select(*made.columns)
    return once.unionByName(fallback)


def source_blocks(payloads: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Items of blocks of sources ({data: [...]} or a bare list); the time is the item's, else an extra's, else the
    block's, else now."""
    inner, bare = F.from_json(column, f"struct<data: array<{BLOCK}>>")["data"], F.from_json(column, f"array<{BLOCK}>")
    block = payloads.select(F.explode(F.coalesce(inner, bare)).alias("b"))
    sid = F.coalesce(_given(F.col("b.id")), F.lit("unknown"))
    title = F.coalesce(*[_given(F.col(f"b.{c}")) for c in ("title", "name", "desc")], sid)
    rows = block.select(F.when(title != sid, F.concat(title, F.lit(" ("), sid, F.lit(")"))).otherwise(sid).alias("source"), times.epoch(F.col("b.updatedTime").try_cast("double")).alias("updated"), F.explode("b.items").alias("i"))
    at = F.coalesce(times.parse_any(F.col("i.pubDate"), now), times.parse_any(F.col("i.extra.date"), now), F.col("updated"), now)
    return _items(rows, "newsnow", "NewsNow", source=F.col("source"), title=_given(F.col("i.title")), url=_given(F.col("i.url")), published=at)


def searched_posts(payloads: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Posts of a search service beside their authors, from the users that the same payload includes."""
    doc = payloads.select(F.monotonically_increasing_id().alias("page"), F.from_json(column, SEARCH).alias("d"))
    posts = doc.select("page", F.explode("d.data").alias("p")).select("page", "p.*")
    users = doc.select("page", F.explode("d.includes.users").alias("u")).select("page", F.col("u.id").alias("author_id"), "u.username").groupBy("page", "author_id").agg(F.max("username").alias("username"))
    who = F.coalesce(_given(F.col("username")), F.lit("i/web"))
    rows = posts.join(users, ["page", "author_id"], "left").withColumn("title", F.nullif(snippet(F.col("text"), POST_SIZE), F.lit("")))
    return _items(rows, "xapi", "X API", source=F.concat(F.lit("@"), who), title=F.col("title"), url=F.concat(F.lit("https://x.com/"), who, F.lit("/status/"), _given(F.col("id"))), published=F.coalesce(times.parse_date(F.col("created_at")), now), post_id=F.col("id"), lang=F.col("lang"))


def tagged_posts(payloads: DataFrame, now: Column, followed: bool = False, excluded: list[str] | None = None, column: str = "payload") -> DataFrame:
    """Posts of a paged social service with a column ``skipped``: null for those that stay, else why one goes.

    ``payloads`` may have page, their order. A search drops empty posts and repetitions; a followed list also other kinds
    than posts and quotes, excluded authors and those with a default picture. Of one post the first by page stays.
    """
    page = F.col("page") if "page" in payloads.columns else F.monotonically_increasing_id()
    rows = payloads.select(page.alias("page"), F.posexplode(F.from_json(column, POSTS)["tweets"]).alias("pos", "t"))
    pid = F.coalesce(_given(F.col("t.id_str")), _given(F.col("t.id")))
    who = _given(F.regexp_replace(F.trim("t.user.screen_name"), "^@+", ""))
    title = F.nullif(snippet(F.coalesce(F.nullif("t.full_text", F.lit("")), "t.text"), POST_SIZE), F.lit(""))
    at = F.coalesce(times.parse_date(F.coalesce(_given(F.col("t.tweet_created_at")), F.col("t.created_at"))), now)
    kind, empty = F.lower(F.coalesce("t.type", F.lit("tweet"))), pid.isNull() | title.isNull()
    if followed:
        names = F.lower(F.coalesce(who, F.lit(""))).isin([n.lower().lstrip("@") for n in excluded or []] or ["?"])
        why = F.when(~kind.isin(LIST_TYPES), "retweet_or_reply").when(names, "excluded_author").when(F.coalesce("t.user.default_profile_image", F.lit(False)), "bot_like").when(empty | who.isNull(), "empty")
    else:
        why = F.when(empty, "empty")
    name = F.coalesce(who, F.lit("i/web"))
    made = rows.select("page", "pos", why.alias("skipped"), pid.alias("post_id"), F.lit("socialdata_x").alias("site_id"), F.lit("SocialData X").alias("site_name"), F.concat(F.lit("@"), name).alias("source"), title.alias("title"), F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), pid).alias("url"), at.alias("published"))
    first = made.where("skipped is null").groupBy("post_id").agg(F.min(F.struct("page", "pos")).alias("first")).select("first.*", "post_id", F.lit(True).alias("_first"))
    # A row for each post: never broadcast, whatever the size of the files lets the planner expect. Rows meet by place, so
    # a post that is repeated often doesn't meet in one task.
    both = made.join(first.hint("merge"), ["page", "pos", "post_id"], "left")
    again = F.col("skipped").isNull() & F.col("_first").isNull()
    return both.withColumn("skipped", F.when(again, "duplicate").otherwise(F.col("skipped"))).select(*made.columns)


def kept_posts(tagged: DataFrame, first: int | None = None) -> DataFrame:
    """The posts that stay, of the first pages' at most ``first`` (a request's own cap)."""
    kept = tagged.where("skipped is null")
    return (kept.orderBy("page", "pos").limit(first) if first else kept).drop("skipped", "page", "pos")


def skip_counts(tagged: DataFrame) -> DataFrame:
    """(skipped, n): how many posts went for each reason."""
    return tagged.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n"))


# Where creator platforms keep a post, its title, owner, address, time and counters.
TIMES = ["time", "create_time", "create_time_stamp", "created_at", "last_update_time", "createTime", "createTimeStamp", "createdAt", "lastUpdateTime", "publish_time", "publishTime", "publish_timestamp"]
VIDEO = {"wrap": ["aweme_info"], "id": ["aweme_id", "awemeId"], "title": ["desc", "title", "caption"], "owner": ["author"], "name": ["nickname", "unique_id"], "url": ["share_url"], "metrics": ["statistics"]}
NOTE = {"wrap": ["note_card", "note_info", "note", "note_data", "noteCard"], "id": ["note_id", "noteId", "id"], "title": ["display_title", "displayTitle", "title", "desc", "description", "content"], "owner": ["user", "user_info"], "name": ["nickname", "nick_name", "nickName", "name"], "url": ["url", "share_url", "shareUrl"], "metrics": ["interact_info"]}
COUNTERS = {"likes": ["digg_count", "liked_count", "likes_count", "like_count"], "comments": ["comment_count", "comments_count"], "collects": ["collect_count", "collected_count"], "shares": ["share_count", "shared_count"]}
#: Posts that a task holds before it passes them on, beside those of one payload, however many payloads a batch has.
SLICE = 2000
AUDIO_TITLE = r"(?i)^@?.{1,80}(?:创作的原声|的原声|original\s+sound)$"


def nested_objects(value) -> Iterator[dict]:
    """Every JSON object inside a value, itself first, from the top down."""
    open_ = [value]
    while open_:
        at = open_.pop()
        if isinstance(at, dict):
            yield at
            open_ += reversed(list(at.values()))
        elif isinstance(at, list):
            open_ += reversed(at)


def values_inside(payloads: DataFrame, column: str = "payload", depth: int = 20) -> DataFrame:
    """Every JSON object and list inside the payloads, up to ``depth`` levels: the other columns, level (from 1), path,
    value (variant) and n_keys (null for lists).

    Spark takes one level after the other apart; the rows of a level are the objects and lists there. A payload that is
    null or no JSON has none.
    """
    spark, others = payloads.sparkSession, [c for c in payloads.columns if c != column]
    level, out = payloads.select(*others, F.lit("$").alias("path"), F.try_parse_json(column).alias("value")), None
    for n in range(1, depth + 1):
        level = level.where("value is not null").withColumn("_kind", F.schema_of_variant("value"))
        level = level.where(F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY"))
        keys = F.when(F.col("_kind").startswith("OBJECT"), F.size(F.json_object_keys(F.to_json("value"))))
        found = level.select(*others, F.lit(n).alias("level"), "path", "value", keys.alias("n_keys"))
        out = found if out is None else out.unionByName(found)
        parts = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "part"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = parts.select(*others, F.concat("path", step).alias("path"), F.col("part").alias("value"))
    return out


def payload_shapes(payloads: DataFrame, by: list[str], column: str = "payload", depth: int = 20) -> DataFrame:
    """(by, objects, lists, depth): payloads in numbers; those that are no JSON are left out."""
    return values_inside(payloads.select(*by, column), column, depth).groupBy(*by).agg(F.count("n_keys").alias("objects"), F.count(F.when(F.col("n_keys").isNull(), 1)).alias("lists"), F.max("level").alias("depth"))


def creator_posts(payloads: DataFrame, site: str, now: Column, column: str = "payload") -> DataFrame:
    """Posts of a creator platform's search results, wherever they stand in the payload, each id once, the first.

    ``site``: tikhub_douyin or tikhub_xiaohongshu. The first acceptable title counts (no name of a sound), the first time
    that reads; a note's time must lie between 2013 and now, else the one in its id counts; a video without is of now.
    """
    where = VIDEO if site == "tikhub_douyin" else NOTE

    def posts(payload: str) -> list[tuple]:
        try:
            top = json.loads(payload)
        except ValueError:
            return []
        out = []
        for node in nested_objects(top):
            note = next((node[k] for k in where["wrap"] if isinstance(node.get(k), dict)), node)
            pick = lambda keys, *of: next((str(o[k]) for o in of for k in keys if o.get(k) not in (None, "", [], {})), None)
            share = note.get("share_info") if isinstance(note.get("share_info"), dict) else {}
            owner = next((o[k] for o in (note, node) for k in where["owner"] if isinstance(o.get(k), dict)), {})
            metrics = next((note[k] for k in where["metrics"] if isinstance(note.get(k), dict)), {})
            titles = [str(note[k]) for k in where["title"] if note.get(k)] + [str(share[k]) for k in ("share_desc", "share_title") if share.get(k)]
            if site != "tikhub_douyin":
                titles = titles[:1] or [t for t in [pick(["display_title", "title", "desc"], node)] if t]
            said = [str(o[k]) for o in (note, node) for k in TIMES if o.get(k) not in (None, "")]
            counts = {**node, **note, **metrics} if site != "tikhub_douyin" else metrics
            found = {n: [str(counts[k]) for k in keys if counts.get(k) is not None] for n, keys in COUNTERS.items()}
            token = pick(["xsec_token"], note, node)
            out.append((pick(where["id"], note, node), titles, pick(where["name"], owner), pick(where["url"], note, share, node), token, said, *found.values()))
        return [p for p in out if p[0] and p[1]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page", "pos", "post_id", "titles", "name", "url", "token", "said", *COUNTERS]
        for part in parts:
            made = ((n, i, *p) for n, text in zip(part.page, part.text) for i, p in enumerate(posts(text or "")))
            while rows := list(islice(made, SLICE)):  # posts hold more memory than their text
                yield pd.DataFrame(rows, columns=names)

    lists = ", ".join(f"{c} array<string>" for c in ("said", *COUNTERS))
    raw = payloads.select(F.monotonically_increasing_id().alias("page"), F.col(column).alias("text")).mapInPandas(run, f"page long, pos int, post_id string, titles array<string>, name string, url string, token string, {lists}")
    title = F.get(F.filter(F.transform("titles", lambda t: snippet(t, POST_SIZE)), lambda t: (t != "") & ~t.rlike(AUDIO_TITLE)), F.lit(0))
    video = site == "tikhub_douyin"
    read = F.transform("said", lambda s: times.parse_any(s, now))
    credible = F.filter(read, lambda t: t.isNotNull() & (F.unix_seconds(t) >= 1356998400) & (t <= now))
    at = F.coalesce(F.get(F.filter(read, lambda t: t.isNotNull()), F.lit(0)), now) if video else F.coalesce(F.get(credible, F.lit(0)), I.id_time(F.col("post_id"), now))
    page = F.concat(F.lit("https://www.douyin.com/video/" if video else "https://www.xiaohongshu.com/explore/"), "post_id", F.lit("") if video else F.coalesce(F.concat(F.lit("?xsec_token="), F.col("token")), F.lit("")))
    count = lambda c: F.coalesce(F.get(F.filter(F.transform(c, lambda v: F.regexp_replace(v, ",", "").try_cast("double")), lambda v: v.isNotNull()), F.lit(0)), F.lit(0.0))
    metrics = F.struct(*[F.greatest(F.lit(0), count(c).cast("long")).alias(c) for c in COUNTERS])
    rows = raw.select("page", "pos", "post_id", F.lit(site).alias("site_id"), F.coalesce(_given(F.col("name")), F.lit("Douyin Search" if video else "Xiaohongshu Search")).alias("source"), title.alias("title"), F.coalesce(_given(F.col("url")), page).alias("url"), at.alias("published"), metrics.alias("creator_metrics")).where("title is not null")
    return best_per_key(rows, ["post_id"], F.struct("page", "pos")).drop("page", "pos")


def item_key(site: Column, post_id: Column, url: Column, title: Column) -> Column:
    """What makes items of several searches one: the post, else URL and title."""
    return F.when(F.trim(F.coalesce(post_id, F.lit(""))) != "", F.concat_ws(":", site, F.trim(post_id))).otherwise(F.concat_ws(":", site, urls.normalize_url(url), F.trim(title)))


def mail_digest(messages: DataFrame, allowed: list[str]) -> DataFrame:
    """Mails (message_id, from, subject, preview, timestamp, attachments array) as digest rows without any body: a short
    id, the sender's domain, shortened and redacted lines; only senders of the allowed domains, if any are named."""
    domain = I.mail_domain(F.col("from"))
    mid = F.coalesce("message_id", F.lit(""))
    n = F.coalesce(F.size(F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType))), F.lit(0))
    rows = messages.where(I.in_domains(domain, allowed))
    return rows.select(F.concat(F.lit("agentmail:"), F.when(mid != "", F.substring(F.sha1(mid.cast("binary")), 1, 12)).otherwise("unknown")).alias("id"), F.lit("email_newsletter").alias("source_type"), F.when(domain.isNotNull(), F.concat(F.lit("AgentMail · "), domain)).otherwise("AgentMail").alias("source"), domain.alias("sender_domain"), snippet(F.col("subject"), 180).alias("subject"), snippet(F.col("preview"), 240).alias("preview"), F.col("timestamp").alias("received_at"), (n > 0).alias("has_attachments"), n.cast("long").alias("attachment_count"))


def allowed_domains(text: str) -> list[str]:
    """The domains of a comma- or space-separated list, lower-cased, sorted, each once; what isn't a domain goes."""
    import re

    parts = (p.strip().lower().lstrip("@") for p in re.split(r"[,\s]+", text or ""))
    return sorted({p for p in parts if re.fullmatch(r"[a-z0-9.-]+\.[a-z]{2,}", p)})

