"""The engine's registered queries over the given tables, each with its SQL where SQL can express it.

News terms are nearly absent from the tables' prose, so the rule operators run with ``PROSE``, a dictionary of words
that occur there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import times, urls
from tidewire.operators import archive, evaluate, events, rank, scoring, stories
from tidewire.plans import dims, sqltext
from tidewire.sources import feeds
from tidewire.streaming import archive_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PROSE = scoring.Rules(signal=["the", "der", "para"], broad=["para"], tech=["ing", "tion", "ment"], noise=["ou", "sch"], commerce=["ñ"], unsafe=["worthless"], tutorial=["stupid"], labels=[("alpha", ["thing", "enst"]), ("beta", ["onen", "ation"]), ("gamma", ["ed "])])
OTHER = scoring.Rules(signal=["and", "der"], broad=["und"], tech=["ing", "ent"], noise=["ou", "ch"], commerce=["ñ"], unsafe=["worthless"], tutorial=["stupid"], labels=[("alpha", ["thing"]), ("gamma", ["ed "])])
EVENTS = events.Events(
    terms={"market": ["thest", "enre"], "security": ["oned", "chst"], "funding": ["or", "un"], "benchmark": ["eval", "ding", "he"]},
    words=["or", "un", "he"],
    exclude={"security": ["stu"]},
    together={"market": (["thing", "enst"], ["and", "der"])},
    unless={"benchmark": (["he"], ["the", "en"])},
    titled={"model_release": (["the", "der"], ["and", "en"])},
    no_sites=("src7",),
)
#: Tiers that stand for the tables' sources.
SITES = [(f"src{i}", *dims.TIERS[i][1:]) for i in range(0, 18)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items: the first line is the title, the id gives a half hour in 2024."""
    title = X.first_line_title(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("site_id"), title.alias("title"), F.col("text").alias("body"), F.concat(F.lit("https://"), "source", F.lit(".example/a?id="), F.pmod("doc_id", F.lit(500)).cast("string"), F.lit("&utm_source=x")).alias("url"), F.timestamp_seconds(F.lit(1704067200) + F.pmod("doc_id", F.lit(2000)) * 1800).alias("event_time"), "lang")


def story_title():
    return X.story_title(F.lit(None).cast("string"), F.col("title"), F.lit(None).cast("string"))


ITEMS = """items AS (SELECT doc_id AS id, source AS site_id, string_split(text, chr(10))[1] AS title, text AS body,
  'https://' || source || '.example/a?id=' || (doc_id % 500)::VARCHAR || '&utm_source=x' AS url,
  to_timestamp(1704067200 + (doc_id % 2000) * 1800) AS event_time, lang FROM documents)"""


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t, r, dims.TIER_WEIGHTS[t]) for s, t, r in SITES], "site_id string, tier string, tier_rank int, tier_weight double")


TIERS = "tiers(site_id, tier, tier_rank, tier_weight) AS (VALUES " + ", ".join(f"('{s}', '{t}', {r}, {dims.TIER_WEIGHTS[t]}::DOUBLE)" for s, t, r in SITES) + ")"


def _lits(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in sorted(set(terms))) + "]"


SCORED = f"{ITEMS}, scored AS (SELECT id, site_id, title, event_time, {sqltext.relevance(PROSE)} FROM (SELECT *, lower(title) AS low FROM items))"


def scored(spark: SparkSession, d: str, rules: scoring.Rules = PROSE) -> DataFrame:
    r = scoring.relevance(F.lower("title"), F.lit(0.1), rules)
    return items(spark, d).select("id", "site_id", "title", "event_time", r.alias("r")).select("id", "site_id", "title", "event_time", "r.*")


URL_SQL = r"""u AS (SELECT page_id, trim(url) AS url, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', ['s', 'h', 'p', 'x', 'q']) AS m FROM pages),
params AS (SELECT *, list_filter(string_split(m.q, '&'), lambda x: x != '') AS ps FROM u)"""


def _url_sql(keep: str) -> str:
    return f"""rtrim(lower(m.s) || '://' || lower(m.h) || m.p || CASE WHEN len(list_filter(ps, lambda x: {keep})) > 0 THEN '?' || array_to_string(list_transform(list_filter(ps, lambda x: {keep}), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') ELSE '' END, '/')"""


_KEY = "lower(string_split(x, '=')[1])"
_NORMAL = _url_sql(f"NOT starts_with({_KEY}, 'utm_') AND NOT {_KEY} IN ({', '.join(repr(t) for t in dims.TRACKING)})")
_CANON = _url_sql(f"{_KEY} IN ('id', 'item', 'p')")


@query(f"WITH {URL_SQL} SELECT page_id, {_NORMAL} AS normal, {_CANON} AS canonical, lower(m.h) AS host FROM params")
def normalize_url(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize_url(u).alias("normal"), urls.canonical_url(u).alias("canonical"), urls.host(u).alias("host"))


@query(f"WITH {URL_SQL} SELECT page_id, sha1(lower('web') || '||' || lower(m.h) || '||' || 'page' || '||' || {_NORMAL}) AS item_id, 'story_' || substr(sha1({_CANON}), 1, 12) AS story_id FROM params")
def item_and_story_ids(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.item_id(F.lit("Web"), urls.host(u), F.lit(" Page "), u).alias("item_id"), urls.story_id(u, F.lit(""), F.col("page_id")).alias("story_id"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS v, o_orderstatus AS site_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS published_at, o_orderdate AS seen FROM orders),
b AS (SELECT l_orderkey AS id, max_by(l_suppkey, row(l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS v, max_by(l_linestatus, row(l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS site_id, min_by(l_shipdate, row(l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS published_at FROM lineitem GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, coalesce(b.v, a.v) AS v, coalesce(b.site_id, a.site_id) AS site_id, coalesce(a.published_at, b.published_at) AS published_at,
 coalesce(a.seen, TIMESTAMP '1998-12-31') AS first_seen_at, CASE WHEN b.id IS NOT NULL THEN TIMESTAMP '1998-12-31' ELSE a.seen END AS last_seen_at FROM a FULL JOIN b ON a.id = b.id""")
def archive_upsert(spark, d):
    return _archive(spark, d)


def _archive(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"), F.col("o_orderstatus").alias("site_id"), F.when(F.col("o_orderkey") % 3 != 0, at).alias("published_at"), at.alias("first_seen_at"), at.alias("last_seen_at"))
    run = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("v"), F.col("l_linestatus").alias("site_id"), F.col("l_shipdate").cast("timestamp").alias("published_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("ingest_seq"))
    return archive.upsert(old, run, "id", F.lit("1998-12-31").cast("timestamp")).select("id", "v", "site_id", "published_at", "first_seen_at", "last_seen_at")


@query(SQL["archive_upsert"].replace("WITH a AS", "SELECT count(*) AS n, count(published_at) AS dated FROM (WITH a AS") + ") WHERE last_seen_at >= TIMESTAMP '1998-12-31' - INTERVAL 1200 DAY")
def archive_prune(spark, d):
    return archive.prune(_archive(spark, d), F.lit("1998-12-31").cast("timestamp"), 1200).agg(F.count("*").alias("n"), F.count("published_at").alias("dated"))


@query("WITH e AS (SELECT *, max(ts) OVER () AS now FROM events) SELECT event_id, ts, event_type FROM e WHERE CASE WHEN event_type = 'error' THEN ts ELSE coalesce(ts, now) END >= now - INTERVAL 48 HOUR")
def event_time_window(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))
    at = times.event_time(F.when(F.col("event_type") == "error", "opmlrss").otherwise(F.col("event_type")), F.col("ts"), F.coalesce("ts", "now"))
    return e.join(F.broadcast(now)).where(at >= F.col("now") - F.make_dt_interval(hours=F.lit(48))).select("event_id", "ts", "event_type")


@query(f"WITH {ITEMS}, {TIERS}, t AS (SELECT i.*, coalesce(tier_rank, 9) AS tier_rank FROM items i LEFT JOIN tiers USING (site_id)) SELECT id, site_id, tier_rank FROM t QUALIFY row_number() OVER (PARTITION BY lower(title), url ORDER BY tier_rank, event_time DESC, title, id) = 1")
def dedupe_title_url(spark, d):
    t = items(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left").select("id", "site_id", F.lower("title").alias("lt"), urls.normalize_url(F.col("url")).alias("u"), F.coalesce("tier_rank", F.lit(9)).alias("tier_rank"), "event_time", "title")
    order = F.struct("tier_rank", (-F.col("event_time").cast("double")).alias("t"), "title", "id")
    return rank.best_per_key(t, ["lt", "u"], order).select("id", "site_id", "tier_rank")


@query(f"WITH {ITEMS} SELECT arg_min(id, sha1(id::VARCHAR)) AS id, count(*) AS n FROM items GROUP BY lower(title)")
def dedupe_hash_order(spark, d):
    return items(spark, d).groupBy(F.lower("title").alias("lt")).agg(F.min_by("id", F.sha1(F.col("id").cast("string").cast("binary"))).alias("id"), F.count("*").alias("n")).select("id", "n")


@query(f"WITH {ITEMS} SELECT site_id, id, title FROM items QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY event_time DESC, id) <= 8")
def first_n_per_source(spark, d):
    return rank.first_by(items(spark, d), ["site_id"], [F.desc("event_time"), F.col("id")], 8).select("site_id", "id", "title")


@query(f"WITH {ITEMS}, {TIERS} SELECT coalesce(tier, 'other') AS tier, coalesce(tier_rank, 9) AS tier_rank, coalesce(tier_weight, 0.25)::DOUBLE AS tier_weight, count(*) AS n FROM items LEFT JOIN tiers USING (site_id) GROUP BY ALL")
def tier_join(spark, d):
    t = items(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left")
    return t.groupBy(F.coalesce("tier", F.lit("other")).alias("tier"), F.coalesce("tier_rank", F.lit(9)).alias("tier_rank"), F.coalesce("tier_weight", F.lit(0.25)).alias("tier_weight")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT id, score, label, related FROM scored")
def relevance_cascade(spark, d):
    return scored(spark, d).select("id", "score", "label", "related")


@query(f"WITH {SCORED} SELECT label, count(*) AS n, avg(score) AS mean_score FROM scored GROUP BY 1")
def label_counts(spark, d):
    return scored(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@query(f"WITH {ITEMS} SELECT id, list_sort(list_filter({_lits(PROSE.tech + PROSE.noise)}, lambda t: contains(lower(body), t))) AS hits FROM items")
def keyword_hits(spark, d):
    return items(spark, d).select("id", X.matched(F.lower("body"), PROSE.tech + PROSE.noise).alias("hits"))


@query(f"WITH {ITEMS} SELECT lang, count(*) AS n FROM items WHERE regexp_matches(lower(body), '(^|[^a-z0-9])(ai|un|he)([^a-z0-9]|$)') GROUP BY 1")
def boundary_terms(spark, d):
    return items(spark, d).where(X.has_word(F.col("body"), ["ai", "un", "he"])).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, {sqltext.events(EVENTS, summary='body')} AS tags FROM items")
def event_tags(spark, d):
    return items(spark, d).select("id", events.business_events(F.col("site_id"), F.col("title"), F.col("body"), EVENTS).alias("tags"))


@query(f"WITH {ITEMS} SELECT id, coalesce(len(list_filter(regexp_split_to_array(lower(body), '[。！？.!?\\n]+'), lambda s: (contains(s, 'thing') OR contains(s, 'enst')) AND contains(s, 'and'))) > 0, false) AS together FROM items")
def cooccurrence(spark, d):
    return items(spark, d).select("id", events.cooccurs(F.coalesce(F.lower("body"), F.lit("")), (["thing", "enst"], ["and"]), []).alias("together"))


_AGE = "date_diff('second', ts, now) / 3600.0"


@query(f"""WITH e AS (SELECT *, max(ts) OVER () AS now FROM events)
SELECT event_id, (greatest(0.0, least(1.0, coalesce(CASE WHEN event_type = 'view' THEN NULL WHEN value > 1 THEN value / 100 ELSE value END, CASE WHEN user_id % 2 = 0 THEN greatest(0.45, 0.6 * 0.72) ELSE 0.6 * 0.6 END))) * 0.30 + 0.58 * 0.22 + 0.6 * 0.20 + least(1.0, pow(0.5, greatest(0, {_AGE}) / 48.0)) * 0.18 + least(1.0, greatest(0.0, (user_id % 6) / 4.0)) * 0.10)::DOUBLE AS importance FROM e""")
def importance(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    age = (F.unix_timestamp("now") - F.unix_timestamp("ts")) / 3600.0
    ed = scoring.editorial(F.when(F.col("event_type") != "view", F.col("value")), F.col("user_id") % 2 == 0, F.lit(0.6))
    return e.select("event_id", scoring.importance(ed, F.lit(0.58), F.lit(0.6), scoring.freshness(age), F.col("user_id") % 6 + 1).alias("importance"))


@query("""WITH e AS (SELECT *, max(ts) OVER () AS now FROM events), c AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 22.0 ELSE 20.0 END AS k, date_diff('second', max(ts), max(now)) / 3600.0 AS age,
 (count(*) FILTER (event_type = 'view') + 2.0 * count(*) FILTER (event_type = 'click') + 1.5 * count(*) FILTER (event_type = 'signup') + 2.0 * count(*) FILTER (event_type = 'purchase'))::DOUBLE AS n FROM e GROUP BY 1),
h AS (SELECT user_id, n, least(100.0, k * log10(1 + n))::DOUBLE AS heat, CASE WHEN age <= 24 THEN 15.0 ELSE 0.0 END::DOUBLE AS bonus FROM c)
SELECT user_id, round(n, 1) AS engagement, round(heat, 1) AS heat, bonus, round(least(100.0, heat * 0.85 + bonus)::DOUBLE, 1) AS hot FROM h""")
def creator_heat(spark, d):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1)).alias(t)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = e.groupBy("user_id").agg(*map(n, ("view", "click", "signup", "purchase")), F.max("ts").alias("latest")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    site = F.when(F.col("user_id") % 2 == 0, "tikhub_xiaohongshu").otherwise("tikhub_douyin")
    age = (F.unix_timestamp("now") - F.unix_timestamp("latest")) / 3600.0
    return c.select("user_id", scoring.creator_ranking(site, F.col("view"), F.col("click"), F.col("signup"), F.col("purchase"), age).alias("r")).select("user_id", "r.*")


@query("""WITH e AS (SELECT *, max(ts) OVER () AS now FROM events), k AS (SELECT user_id, count(DISTINCT event_type) AS sources, max(ts) AS latest, max(now) AS now FROM e GROUP BY 1)
SELECT user_id, sources, CASE WHEN sources < 2 THEN 0.0 ELSE (sources - 1) * exp(-date_diff('second', latest, now) / 3600.0 / 12) END::DOUBLE AS hot FROM k""")
def hotness(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("sources"), F.max("ts").alias("latest"))
    k = k.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return k.select("user_id", "sources", scoring.hotness(F.col("sources"), (F.unix_timestamp("now") - F.unix_timestamp("latest")) / 3600.0).alias("hot"))


@query(f"WITH {SCORED} SELECT site_id, count(*) AS items, sum(related::INT)::BIGINT AS kept, sum(related::INT) / count(*) AS keep_rate FROM scored GROUP BY 1")
def keep_rate(spark, d):
    return evaluate.keep_rates(scored(spark, d), "site_id")


@query(f"WITH {SCORED} SELECT s.id, s.score, l.quality FROM scored s JOIN labels l ON l.doc_id = s.id WHERE s.score >= 0.3 AND s.score < 0.65")
def review_band(spark, d):
    s = scored(spark, d).where((F.col("score") >= 0.3) & (F.col("score") < dims.KEEP_AT))
    return s.join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").select("id", "score", "quality")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT source || '::' || lang) AS source_langs FROM documents")
def payload_totals(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct(F.concat_ws("::", "source", "lang")).alias("source_langs"))


@query("""WITH s AS (SELECT user_id % 40 AS site, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS found FROM events GROUP BY 1)
SELECT count(*) AS sites, count(*) FILTER (errors = 0) AS healthy, coalesce(list_sort(list(site) FILTER (found = 0)), []) AS zero_sites, sum(n)::BIGINT AS items FROM s""")
def status_rollup(spark, d):
    e = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    s = table(spark, d, "events").groupBy((F.col("user_id") % 40).alias("site")).agg(F.count("*").alias("n"), e("error").alias("errors"), e("purchase").alias("found"))
    return s.agg(F.count("*").alias("sites"), F.count(F.when(F.col("errors") == 0, 1)).alias("healthy"), F.array_sort(F.collect_list(F.when(F.col("found") == 0, F.col("site")))).alias("zero_sites"), F.sum("n").alias("items"))


@query("SELECT user_id, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN 'reading' ELSE 'item:' || event_id::VARCHAR END) AS votes FROM events GROUP BY 1")
def group_aware_votes(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(rank.votes(F.when(F.col("event_type").isin("view", "click"), F.lit("reading")), F.col("event_id")).alias("votes"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 2)")
def multi_source_keys(spark, d):
    e = table(spark, d, "events")
    keys = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n > 2")
    return e.join(keys, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_and_anti_stories(spark, d):
    li = table(spark, d, "lineitem")
    key = lambda rows: rows.select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(key(li.where("l_returnflag = 'R'")), "o_orderkey", "left_semi").join(key(li.where("l_quantity > 45")), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(f"WITH {ITEMS}, g AS (SELECT site_id, lang, count(*) AS n, max(event_time) AS latest FROM items GROUP BY 1, 2) SELECT site_id, lang, n, sum(n) OVER (PARTITION BY site_id)::BIGINT AS site_n, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, lang) AS place FROM g")
def two_level_groups(spark, d):
    g = items(spark, d).groupBy("site_id", "lang").agg(F.count("*").alias("n"), F.max("event_time").alias("latest"))
    w = Window.partitionBy("site_id")
    return g.select("site_id", "lang", "n", F.sum("n").over(w).alias("site_n"), F.row_number().over(w.orderBy(F.desc("n"), "lang")).alias("place"))


@query("""WITH s AS (SELECT event_id AS story_id, event_type AS source, event_id::VARCHAR AS title, value / 1000 AS score FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, title, story_id) AS source_pick FROM s)
SELECT story_id, source, score - (source_pick - 1) * 0.03 AS adjusted FROM p ORDER BY adjusted DESC, score DESC, title, story_id LIMIT 20""")
def diverse_top(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("story_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("title"), (F.col("value") / 1000).alias("score"))
    return rank.penalised(s, 20).select("story_id", "source", "adjusted")


_TOKENS = r"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce(title, '')), 'https?://\S+', ' ', 'g'), '[a-z0-9]+|[一-鿿]{2,}'), lambda t: length(t) >= 2 AND NOT t IN (" + ", ".join(f"'{t}'" for t in dims.TITLE_STOPWORDS) + ")))"


@query(f"WITH {ITEMS} SELECT id, list_sort({_TOKENS}) AS tokens FROM items")
def title_token_sets(spark, d):
    return items(spark, d).select("id", F.array_sort(X.title_tokens(F.col("title"))).alias("tokens"))


@query(f"""WITH {ITEMS}, t AS (SELECT id, site_id, {_TOKENS} AS k FROM items), a AS (SELECT * FROM t WHERE site_id = 'src1' AND len(k) > 0), b AS (SELECT * FROM t WHERE site_id IS DISTINCT FROM 'src1' AND len(k) > 0),
p AS (SELECT a.id, b.id AS other, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) AS jaccard FROM a JOIN b ON len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) >= 0.5)
SELECT id, arg_max(other, row(jaccard, -other)) AS other, max(jaccard) AS jaccard FROM p GROUP BY 1""")
def token_overlap(spark, d):
    t = items(spark, d).select("id", "site_id", X.title_tokens(F.col("title")).alias("tokens"))
    mine = F.coalesce(F.col("site_id") == "src1", F.lit(False))
    return evaluate.token_overlap(t.where(mine), t.where(~mine))


@query("WITH c AS (SELECT item_id AS id, lower(trim(text)) AS k FROM benchmark), h AS (SELECT DISTINCT lower(trim(line)) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT count(*) AS items, count(h.k) AS hits, CASE WHEN count(*) < 5 THEN 'watchlist' WHEN count(h.k) / count(*) >= 0.65 THEN 'skip' WHEN count(h.k) / count(*) >= 0.35 THEN 'watchlist' ELSE 'accept' END AS action FROM c LEFT JOIN h USING (k)")
def overlap_report(spark, d):
    key = lambda c: F.lower(F.trim(c)).alias("url_key")
    base = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(key(F.col("line")))
    hit = evaluate.url_overlap(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), key(F.col("text"))), base)
    n, hits = F.count("*"), F.count(F.when(F.col("hit"), 1))
    return hit.agg(n.alias("items"), hits.alias("hits"), evaluate.recommendation(n, hits / n).alias("action"))


@query(f"WITH {SCORED}, other AS (SELECT id, {sqltext.relevance(OTHER)} FROM (SELECT *, lower(title) AS low FROM items)) SELECT a.related AS was, b.related AS now, a.label AS from_label, b.label AS to_label, count(*) AS items FROM scored a JOIN other b USING (id) WHERE a.related != b.related OR a.label != b.label GROUP BY ALL")
def scoring_replay(spark, d):
    return evaluate.flips(scored(spark, d), scored(spark, d, OTHER))


@query(r"SELECT doc_id, sha1(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted-email]', 'g'), '(?i)\b(sk-[A-Za-z0-9_-]{12,}|(api[_-]?key|secret|token)=([^\s&]{6,}))\b', '[redacted-secret]', 'g')) AS redacted, NOT regexp_matches(text, '[一-鿿]') AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= greatest(6, length(text) // 4) AS english FROM documents")
def redact_and_language(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(X.redact(F.col("text")).cast("binary")).alias("redacted"), X.is_mostly_english(F.col("text")).alias("english"))


@query(r"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted-email]', 'g'), '(?i)\b(sk-[A-Za-z0-9_-]{12,}|(api[_-]?key|secret|token)=([^\s&]{6,}))\b', '[redacted-secret]', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(substr(t, 1, 239)) || '…' ELSE t END AS snippet FROM f""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp((1700000000 + event_id) * 1000000) ELSE make_timestamp((1700000000000 + event_id) * 1000) END AS at FROM events")
def epoch_times(spark, d):
    return table(spark, d, "events").select("event_id", times.epoch(F.when(F.col("event_id") % 2 == 0, F.lit(1700000000) + F.col("event_id")).otherwise(F.lit(1700000000000) + F.col("event_id"))).alias("at"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts - INTERVAL (event_id % 50) MINUTE WHEN 1 THEN ts - INTERVAL (event_id % 20) HOUR WHEN 2 THEN ts - INTERVAL 1 DAY ELSE ts END AS at FROM events")
def relative_times(spark, d):
    n = lambda m: F.pmod("event_id", F.lit(m)).cast("string")
    said = F.when(F.col("event_id") % 4 == 0, F.concat(n(50), F.lit(" 分钟前"))).when(F.col("event_id") % 4 == 1, F.concat(n(20), F.lit(" hours ago"))).when(F.col("event_id") % 4 == 2, F.lit("昨天")).otherwise(F.lit("just now"))
    return table(spark, d, "events").select("event_id", times.relative(said, F.col("ts").cast("timestamp")).alias("at"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def html_items(spark, d):
    return feeds.page_items(table(spark, d, "pages")).select("page_id", "title", "n_links")


@query("SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c.conv_id, c.turn, max(CASE WHEN p.role = 'user' THEN p.turn END) AS heading FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn <= c.turn AND p.turn >= c.turn - 20 GROUP BY ALL")
def nearest_ancestor(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-20, 0)
    return c.select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("heading"))


@query(f"WITH {SCORED}, {TIERS} SELECT id, title, coalesce(tier_rank, 9) AS tier_rank, score FROM scored LEFT JOIN tiers USING (site_id) WHERE related ORDER BY tier_rank, score DESC, event_time DESC, id LIMIT 30")
def consumer_topn(spark, d):
    s = scored(spark, d).where("related").join(F.broadcast(tiers(spark)), "site_id", "left").withColumn("tier_rank", F.coalesce("tier_rank", F.lit(dims.OTHER_RANK)))
    return s.orderBy("tier_rank", F.desc("score"), F.desc("event_time"), "id").limit(30).select("id", "title", "tier_rank", "score")


@query(f"WITH {SCORED} SELECT id, label FROM scored WHERE related AND label = 'beta' AND contains(lower(title), 'on')")
def consumer_filters(spark, d):
    return scored(spark, d).where(F.col("related") & (F.col("label") == "beta") & F.contains(F.lower("title"), F.lit("on"))).select("id", "label")


@query()
def near_duplicate_titles(spark, d):
    s = scored(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left").withColumn("tier_rank", F.coalesce("tier_rank", F.lit(9)))
    return stories.suppress_near_duplicates(s.withColumn("title", story_title()))


@query()
def story_clusters(spark, d):
    return stories.story_clusters(items(spark, d).withColumn("url", urls.canonical_url(F.col("url"))).withColumn("title", story_title()))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def stream_first_last_seen(spark, d):
    schema = table(spark, d, "events").schema
    return archive_stream.first_last_seen(spark, f"{d}/events.parquet*", schema, "user_id", "ts")


@query("""WITH e AS (SELECT user_id AS id, max_by(event_type, event_id) AS site_id, max_by(value, event_id) AS v, min_by(ts, event_id) AS published_at, max(ts) AS latest FROM events GROUP BY 1)
SELECT id, site_id, v, published_at FROM e WHERE published_at >= (SELECT max(ts) FROM events) - INTERVAL 1800 HOUR""")
def stream_archive(spark, d):
    schema = table(spark, d, "events").schema
    now = F.lit(table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])

    def prepare(batch):
        return batch.select(F.col("user_id").alias("id"), F.col("event_type").alias("site_id"), F.col("value").alias("v"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_id").alias("ingest_seq"))

    held = archive_stream.archived(spark, f"{d}/events.parquet*", schema, "id", prepare, now, 21)
    return archive_stream.visible(held, now, 1800).select("id", "site_id", "v", "published_at")
