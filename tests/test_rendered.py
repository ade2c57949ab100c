"""Queries over rendered payloads against their SQL, and the cases that their tables lack."""

import datetime as dt
import hashlib
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tidewire.operators import evaluate, payloads
from tidewire.plans import queries as Q
from tidewire.plans import rendered as R
from tidewire.sources import feeds

NAMES = [n for n in Q.SQL if Q.QUERIES[n].__module__ == R.__name__]
#: What the stories' rounds make slow; the driver compares these as well.
SLOW = {"news_stories", "news_merge_log", "story_item_links", "creators_hot", "item_pages"}


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_rendered_queries_equal_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "events", "orders", "lineitem", "customer", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list | tuple) else round(v, 6) if isinstance(v, float) else v
    got = Q.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    want = con.execute(Q.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(repr(plain(tuple(r[c] for c in cols))) for r in got.collect()) == sorted(repr(plain(tuple(r[i] for i in at))) for r in want.fetchall())


def test_repeated_entries_of_short_titles_equal_the_sql(spark, tmp_path):
    """An entry that is too short for its source stands twice: neither counts."""
    import duckdb

    rows = [(11 * (k + 150), f"{'x' * n}\nbody", "en", f"src{s}", n) for k, (n, s) in enumerate([(24, 3), (29, 3), (30, 3), (0, 6), (24, 6)], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("catalogue_feeds", "collected_sources"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.SQL[name]})").fetchall()
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want)) and want


def test_feeds_equal_a_plain_reader(spark):
    rss = '<?xml version="1.0"?><rss xmlns:dc="d"><channel><title>T</title><!-- <item><title>hidden</title><link>h</link></item> --><item><title>a <![CDATA[b & c]]></title><link note="1>2">https://f/1</link><dc:date>2026-07-01</dc:date></item><item><title>A &amp; B &#8212; é</title><link>https://f/2</link><pubDate>p</pubDate></item></channel></rss>'
    atom = '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title type="html">E &lt;i&gt;</a:title><a:link rel="self" href="https://g/self"/><a:link href="https://g/1?a=1&amp;b=2"/><a:updated>u</a:updated></a:entry></a:feed>'
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel rdf:about="c"/><item rdf:about="i"><title>R</title><link>https://r/1</link></item></rdf:RDF>'
    loose = "<rss><channel><item><title>x &nbsp; y & z &copy;</title><link>https://l/1?a=1&b=2</link></item></channel></rss>"
    rows = [("rss", rss), ("atom", atom), ("rdf", rdf), ("loose", loose), ("cut", rss[:-20]), ("no xml", "plain words"), ("empty", ""), ("none", None), ("bare", "<rss><channel/></rss>"), ("rss", rss)]
    frame = spark.createDataFrame(rows, "feed string, payload string")

    def plainly(text):
        out, local = [], lambda e: e.tag.rpartition("}")[2]
        for e in ET.fromstring(text).iter():
            if local(e) in ("item", "entry"):
                parts = {local(c): c for c in e}
                links = [c for c in e if local(c) == "link" and c.get("rel", "alternate") == "alternate"]
                out.append((" ".join("".join(parts["title"].itertext()).split()), links[0].get("href") or links[0].text))
        return out

    read = {}
    for r in feeds.feed_items(frame).collect():
        read.setdefault(r.feed, []).append((r.pos, r.title, r.link))
    for name, text in (("rss", rss), ("atom", atom), ("rdf", rdf)):
        assert [(t, k) for _, t, k in sorted(set(read[name]))] == plainly(text)
    assert read["loose"] == [(0, "x   y & z &copy;".replace("   ", "   "), "https://l/1?a=1&b=2")] and len(read["rss"]) == 4
    assert {(r.feed, r.error) for r in feeds.read_feeds(frame).collect() if r.error} == {("cut", "unreadable"), ("no xml", "unreadable"), ("empty", "unreadable"), ("none", "missing"), ("bare", "no entries")}
    assert feeds.feed_items(frame.limit(0)).count() == 0


def test_collecting_from_broken_sources_alone_gives_an_empty_table(spark):
    def broken():
        raise ValueError("unreadable")

    rows, statuses = feeds.collected({"a": broken, "b": lambda: spark.createDataFrame([], "title string, url string, site_id string")})
    assert rows.count() == 0 and {"title", "url", "ingest_seq"} <= set(rows.columns)
    assert [(s["ok"], s["error"]) for s in statuses] == [(False, "ValueError"), (False, "no items parsed")]


def test_overlap_of_rows_with_hashed_ids(spark):
    ids = [hashlib.sha1(str(n).encode()).hexdigest() for n in range(4)]
    at = dt.datetime(2026, 6, 1)
    columns = "id string, site_id string, title string, url string, at timestamp"
    a = spark.createDataFrame([(ids[0], "s", "OpenAI ships a new model today", "https://x/1", at)], columns)
    b = spark.createDataFrame([(i, "t", "OpenAI ships a new model today", "https://x/1", at) for i in ids[1:]], columns)
    best = evaluate.best_matches(a, b).first()
    assert (best.other, best.match_type, best.score) == (min(ids[1:]), "url_exact", 1.0)
    sets = lambda rows: spark.createDataFrame(rows, "id string, tokens array<string>")
    got = evaluate.token_overlap(sets([(ids[0], ["a", "b", "c"])]), sets([(ids[1], ["a", "b", "c", "d"]), (ids[2], ["a", "b", "c"]), (ids[3], ["a", "b", "c"])])).first()
    assert (got.other, got.jaccard) == (min(ids[2:]), 1.0)
    assert evaluate.overlapping_sites(evaluate.best_matches(a, b)).collect()[0].matched == 1


def test_brief_of_the_news_equals_the_greedy_pick(spark, small):
    got = sorted(Q.QUERIES["news_brief"](spark, small).collect(), key=lambda r: r.place)
    assert got and [r.place for r in got] == list(range(1, len(got) + 1))
    assert all(r.source_count >= 2 or r.score >= 0.72 for r in got) or min(r.score for r in got) > 0
    scores = [r.score for r in got]
    assert len({r.title for r in got}) == len(got) and max(scores) == scores[0]


def test_published_headers_count_their_rows(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, ai_is_related boolean")
    made = payloads.latest_views(rows.where("ai_is_related"), rows, F.lit("2026-06-01 10:00:00").cast("timestamp"))
    slim, bulky = made["latest_header"].first(), made["all_header"].first()
    assert (slim.total_items, bulky.total_items_all_mode, slim.generated_at) == (2, 3, "2026-06-01T10:00:00Z")


def test_creator_posts_pass_on_in_slices(spark):
    """A batch of payloads with more posts than a slice gives each post once, in several parts."""
    import json

    from tidewire.sources import services

    made = [json.dumps({"data": [{"aweme_info": {"aweme_id": f"v{n}-{i}", "desc": f"video {i}"}} for i in range(services.SLICE - 1)]}) for n in range(3)]
    frame = spark.createDataFrame([(m,) for m in made], "payload string").coalesce(1)
    posts = services.creator_posts(frame, "tikhub_douyin", R.now())
    assert posts.count() == posts.select("post_id").distinct().count() == 3 * (services.SLICE - 1)


def test_repeated_posts_are_found_without_a_broadcast(spark, tmp_path, capsys):
    import json

    from tidewire.sources import services

    post = lambda i, text="said": {"id_str": str(i), "full_text": text, "user": {"screen_name": "u"}}
    pages = [(1, [post(1), post(2), post(1), post(3, " ")]), (2, [post(2), post(4), {"full_text": "no id"}]), (2, [post(5)]), (3, [post(1)] * 3)]
    spark.createDataFrame([(n, json.dumps({"tweets": t})) for n, t in pages], "page long, payload string").write.parquet(str(tmp_path / "p"))
    tagged = services.tagged_posts(spark.read.parquet(str(tmp_path / "p")), R.now())
    got = sorted((r.page, r.pos, r.post_id or "", r.skipped or "") for r in tagged.collect())
    assert got == [(1, 0, "1", ""), (1, 1, "2", ""), (1, 2, "1", "duplicate"), (1, 3, "3", "empty"), (2, 0, "2", "duplicate"), (2, 0, "5", ""), (2, 1, "4", ""), (2, 2, "", "empty"), *[(3, i, "1", "duplicate") for i in range(3)]]
    tagged.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_identities_of_stories_are_read_once_and_not_broadcast(spark, tmp_path, capsys):
    from tidewire.functions import items as I
    from tidewire.operators import query

    item = "struct<id: string, title: string, title_zh: string, url: string, source: string>"
    rows = [
        (1, "OpenAI ships", "u1", ("i1", "OpenAI ships", None, "u2", ""), [("i1", "OpenAI ships", "", "u1", None), ("", None, "《新的大模型》发布", None, "x")]),
        (2, "Another day", None, None, None),
        (3, None, "u2", None, [(None, None, None, None, None)]),
        (4, "Quiet week", "u4", None, [("i4", "uncensored pictures and nsfw nudes by AI", None, None, "s")]),
    ]
    spark.createDataFrame(rows, f"story_id long, title string, url string, primary_item {item}, items array<{item}>").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    title = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("title_zh", "title", "title_en", "title_original")])
    keys = F.array_compact(F.array(F.concat(F.lit("url:"), F.nullif("url", F.lit(""))), F.concat(F.lit("id:"), F.nullif("id", F.lit(""))), F.when(title.isNotNull(), F.concat(F.lit("event:"), I.event_key(title))), F.when(title.isNotNull(), F.concat(F.lit("title:"), F.substring(I.event_text(title), 1, 34)))))
    want = {tuple(r) for r in query.story_refs(s).select("story_id", F.explode(keys)).collect()}
    got = [tuple(r) for r in query.identity_keys(s).collect()]
    assert set(got) == want and len(got) == len(want) > 12
    bad = {r.story_id for r in query.story_refs(s).where(query.unsafe()).collect()}
    assert bad == {4} and {r.story_id for r in query.safe_stories(s).collect()} == {1, 2, 3}
    pools = query.story_pools(s.where("story_id = 1"), s, spark.createDataFrame([], "id string, url string"), query.ViewQuery())
    assert {k: {r.story_id for r in df.collect()} for k, df in pools.items()} == {"brief": {1}, "merged": {1, 2, 3}, "followup": {2}}
    pools["followup"].explain()
    assert "Broadcast" not in capsys.readouterr().out
