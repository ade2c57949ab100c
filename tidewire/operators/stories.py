"""Near-duplicate suppression and leader clustering of items into stories.

Both are greedy in time order. Similar titles come from ``similar``; what depends on the order is then replayed chain by
chain of similar titles, so a chain is gathered into one task, but no site is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.items import is_mergeable
from tidewire.operators.graph import components, settled
from tidewire.operators.similar import Leaders, band_of, leader_bag, parted, similar_titles, story_similarity, title_chains


def _ordered(items: DataFrame) -> Column:
    rank = F.col("tier_rank") if "tier_rank" in items.columns else F.lit(0)
    return F.struct("event_time", rank.cast("int").alias("tier_rank"), "title", "id")


def story_clusters(items: DataFrame, hours: float = 6.0, threshold: float = 0.86) -> DataFrame:
    """(id, leader, reason, similarity): each item's story, named by its leader's id, over the items of all sites.

    Columns: id, title (normalised for stories), url (canonical), event_time; with tier_rank, it orders items of one
    time. An item whose URL an earlier one has joins that one's story (canonical_url, 1.0); else the first story whose
    leader is at most ``hours`` older and has a similar title of no other vendor or model (title_similarity); else it
    leads a story of its own (null reason). Titles of fewer than 4 tokens or 18 characters lead stories but join none by
    title; items without a time meet others by URL only.

    An item leads if no earlier similar item within the window leads. That is replayed chain by chain of similar titles
    (see ``title_chains``), and there items meet only the leaders of the window, so no pairs of items are stored.
    """
    seconds = F.col("event_time").cast("double")
    rows = settled(items.select("id", "title", F.coalesce("url", F.lit("")).alias("url"), seconds.alias("ts"), band_of(seconds, hours).alias("band"), _ordered(items).alias("o")))
    firsts = rows.where("url != ''").groupBy("url").agg(F.min("o").alias("o"))
    heads = settled(rows.where("url = ''").unionByName(rows.join(firsts, ["url", "o"], "left_semi")).withColumn("open", F.coalesce(is_mergeable(F.col("title")) & F.col("ts").isNotNull(), F.lit(False))))
    chains = title_chains(heads.select(F.lit("").alias("scope"), "band", "title", "open"), threshold)
    placed = settled(heads.join(chains, "title", "left"))
    # A chain of one row, or without an open title, has only leaders.
    several = placed.where("ts is not null").groupBy("chain").agg(F.count("*").alias("n"), F.max("open").alias("some")).where("n > 1 and some").select("chain")

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        out, leaders, known = [], Leaders(), {}
        for r in part.sort_values(["ts", "tier_rank", "title", "id"], na_position="first").itertuples():
            tokens, bag, found = set(r.tokens), leader_bag(r.title), None
            for other, o_tokens in leaders.alike(r.ts, hours * 3600, bag, len(r.title), threshold) if r.open else ():
                if (r.title, other.title) not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    contrary = parted(r.vendors, other.vendors) or parted(r.models, other.models)
                    same = r.title == other.title
                    known[r.title, other.title] = 1.0 if same else 0.0 if contrary else story_similarity(r.title, other.title, tokens, o_tokens, threshold)
                if known[r.title, other.title] >= threshold:
                    found = (other.id, "title_similarity", known[r.title, other.title])
                    break
            if found is None:
                leaders.add((r, tokens), r.ts, bag, len(r.title))
            out.append((r.id, *(found or (r.id, None, None))))
        return pd.DataFrame(out, columns=["id", "leader", "reason", "similarity"])

    title, kind = F.col("title"), items.schema["id"].dataType.simpleString()
    crowded = placed.where("ts is not null").join(several, "chain", "left_semi").select("chain", "id", "title", "ts", "o.tier_rank", "open", X.title_tokens(title).alias("tokens"), X.vendors(title).alias("vendors"), X.models(title).alias("models"))
    joined = settled(crowded.groupBy("chain").applyInPandas(replay, f"id {kind}, leader {kind}, reason string, similarity double"))
    alone = placed.join(several.withColumn("met", F.lit(True)), "chain", "left").where("ts is null or met is null")
    led = alone.select("id", F.col("id").alias("leader"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("similarity"))
    settled_heads = settled(joined.unionByName(led))
    stories = heads.where("url != ''").join(settled_heads, "id").select("url", "leader")
    same = rows.where("url != ''").join(heads.select("id"), "id", "left_anti").join(stories, "url").select("id", "leader", F.lit("canonical_url").alias("reason"), F.lit(1.0).alias("similarity"))
    return settled_heads.unionByName(same)


STORY = ["id", "title", "url", "event_time", "tier_rank", "leader", "reason", "similarity"]


def extended_clusters(standing: DataFrame | None, items: DataFrame, hours: float = 6.0, threshold: float = 0.86) -> DataFrame:
    """``items`` (id, title, url, event_time, tier_rank) with leader, reason and similarity (``STORY``), placed beside the
    stories of ``standing`` (``STORY``, of all earlier batches; None for the first).

    Batches that follow each other in time get what one run over all of them gives (see ``story_clusters``): an earlier
    item with the same URL settles an item's story, and else only the standing leaders of the last ``hours`` before the
    batch can be met, so just these and the batch are searched. An item older than standing ones is placed as if it had
    come with its batch: it may lead, but what stands stays.
    """
    names = STORY[:5]
    if standing is None:
        return items.select(*names).join(settled(story_clusters(items, hours, threshold)), "id").select(*STORY)
    at = lambda df: F.struct(df["event_time"], df["tier_rank"].cast("int").alias("tier_rank"), df["title"], df["id"])
    pages = standing.where("url != ''").groupBy("url").agg(F.min_by("leader", at(standing)).alias("leader"))
    fresh = items.select(*names)
    known = settled(fresh.where("url != ''").join(pages, "url").select(*names, "leader", F.lit("canonical_url").alias("reason"), F.lit(1.0).alias("similarity")))
    rest = settled(fresh.join(known.select("id"), "id", "left_anti"))
    first = rest.agg((F.min("event_time") - F.make_dt_interval(secs=F.lit(hours * 3600))).alias("_lo"))  # one row
    leaders = standing.where("id = leader").join(F.broadcast(first)).where("event_time >= _lo").select(*names)
    placed = settled(story_clusters(rest.unionByName(leaders), hours, threshold))
    return known.unionByName(rest.join(placed, "id").select(*STORY))


def suppress_near_duplicates(items: DataFrame, hours: float = 6.0, threshold: float = 0.9) -> DataFrame:
    """The ids that stay, with their site. Columns: id, site_id, title (normalised), event_time, tier_rank, score.

    In time order within a site, a row meets the rows kept before it, newest first, up to ``hours`` older; the first of
    at least half the same tokens and a similar title of no other vendor or model is its copy, and of the two the better
    one (tier, score, time) stays in its place. A row whose title has fewer than 4 tokens or 18
    characters is no one's copy, though a later row may replace it; rows without a time always stay.

    Rows without any similar one need no order, nor do those whose titles are too short to be copies and similar to none
    that can be one. The others are replayed chain by chain: a chain is one site's similar titles in neighbouring bands.
    A row meets those kept rows of the window that hold one of its rarest tokens, which loses none of half the same tokens.
    """
    seconds = F.col("event_time").cast("double")
    rows = settled(items.select("id", "site_id", "title", F.col("tier_rank").cast("int").alias("tier_rank"), F.col("score").cast("double").alias("score"), seconds.alias("ts"), band_of(seconds, hours).alias("band"), is_mergeable(F.col("title")).alias("mergeable")))
    scope = F.coalesce("site_id", F.lit(""))
    cell = lambda title, band: F.xxhash64("scope", title, band)
    held = settled(rows.where("ts is not null").groupBy(scope.alias("scope"), "title", "band").agg(F.count("*").alias("n"), F.coalesce(F.first("mergeable"), F.lit(False)).alias("open")))
    # The measure isn't symmetric, so a pair may be similar in one direction alone.
    pairs = similar_titles(held.select("scope", "band", "title", "open"), threshold, 0.5).select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = held.where("open").select("scope", F.col("title").alias("a"), F.col("title").alias("b")).distinct()
    step = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("other")
    met = pairs.unionByName(own).join(held.select("scope", F.col("title").alias("a"), "band", step), ["scope", "a"])
    met = met.join(held.select("scope", F.col("title").alias("b"), F.col("band").alias("other")), ["scope", "b", "other"])
    chains = components(met.select(cell("a", "band").alias("src"), cell("b", "other").alias("dst")))
    keyed = rows.withColumn("scope", scope).withColumn("node", cell("title", "band"))
    # A cell of its own with several rows is a chain as well.
    crowded = held.where("open and n > 1").select(cell("title", "band").alias("node"))
    roots = settled(chains.unionByName(crowded.join(chains, "node", "left_anti").select("node", F.col("node").alias("root"))))
    placed = keyed.where("ts is not null").join(roots, "node", "left").select("id", "site_id", "title", "tier_rank", "score", "ts", "mergeable", "root")
    alone = placed.where("root is null").select("id", "site_id").unionByName(keyed.where("ts is null").select("id", "site_id"))

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        held: dict[str, set[int]] = {}  # the places of kept rows by their tokens, without those found too old
        known: dict[tuple[str, str], bool] = {}

        def moved(at: int, row: tuple, into: bool) -> None:
            for t in row[1]:
                (held.setdefault(t, set()).add if into else held[t].discard)(at)

        for r in part.sort_values(["ts", "tier_rank", "title", "id"]).itertuples():
            tokens = set(r.tokens)
            # Of half the same tokens at least one is among the rarest so many.
            rare = sorted(tokens, key=lambda t: len(held.get(t, ())))[: len(tokens) // 2 + 1] if r.mergeable else ()
            for at in sorted(set().union(*(held.get(t, ()) for t in rare)), reverse=True):
                other, o_tokens = kept[at]
                if r.ts - other.ts > hours * 3600:
                    moved(at, kept[at], False)  # later rows are still farther
                    continue
                if len(tokens & o_tokens) < 0.5 * len(tokens | o_tokens) or parted(r.vendors, other.vendors) or parted(r.models, other.models):
                    continue
                if (r.title, other.title) not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[r.title, other.title] = story_similarity(r.title, other.title, tokens, o_tokens, threshold) >= threshold
                if known[r.title, other.title]:
                    if (-r.tier_rank, r.score, -r.ts) > (-other.tier_rank, other.score, -other.ts):
                        moved(at, kept[at], False)
                        kept[at] = (r, tokens)
                        moved(at, kept[at], True)
                    break
            else:
                kept.append((r, tokens))
                moved(len(kept) - 1, kept[-1], True)
        return pd.DataFrame({"id": [k.id for k, _ in kept], "site_id": [k.site_id for k, _ in kept]})

    title = F.col("title")
    chained = placed.where("root is not null").select("root", "id", "site_id", "title", F.coalesce("tier_rank", F.lit(99)).alias("tier_rank"), F.coalesce("score", F.lit(0.0)).alias("score"), "ts", F.coalesce("mergeable", F.lit(False)).alias("mergeable"), X.title_tokens(title).alias("tokens"), X.vendors(title).alias("vendors"), X.models(title).alias("models"))
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in ("id", "site_id"))
    return chained.groupBy("root").applyInPandas(replay, kinds).unionByName(alone)
