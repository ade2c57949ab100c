"""Registered queries of the views, gates and derived item columns; see ``queries`` for the tables they stand on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import display as D
from tidewire.functions import items as I
from tidewire.functions import times, urls
from tidewire.operators import evaluate, gates, rank, scoring, views
from tidewire.operators import query as Q
from tidewire.plans import dims, sqltext
from tidewire.plans.queries import ITEMS, OTHER, PROSE, SCORED, TIERS, items, query, scored, story_title, table, tiers
from tidewire.sources import published

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'https?://\S+', '', 'g'), '[\s　]+', '', 'g'), '" + I.MARKS + "', '', 'g')"
_TITLE, _BOOK = _PLAIN.format("title"), "regexp_extract(coalesce(title, ''), '《([^》]{4,40})》', 1)"
_PRODUCT = f"regexp_extract({_TITLE}, '{I.PRODUCTS}', 1)"
EVENT_KEY = f"CASE WHEN {_BOOK} != '' THEN 'book:' || substr({_PLAIN.format(_BOOK)}, 1, 36) WHEN {_PRODUCT} != '' THEN 'entity:' || {_PRODUCT} ELSE 'title:' || substr({_TITLE}, 1, 34) END"


@query(f"WITH {ITEMS} SELECT id, {EVENT_KEY} AS event_key FROM items")
def event_keys(spark, d):
    return items(spark, d).select("id", I.event_key(F.col("title")).alias("event_key"))


@query(f"""WITH {SCORED}, {TIERS}, r AS (SELECT id, site_id, {EVENT_KEY} AS event_key, -coalesce(tier_rank, 9) AS priority, score * 100 AS score, epoch(event_time)::BIGINT AS ts FROM scored LEFT JOIN tiers USING (site_id)),
g AS (SELECT event_key, arg_max(id, row(priority, score, ts, -id)) AS primary_id, count(DISTINCT site_id) AS source_count, count(*) AS merged_count, max(score) AS top FROM r GROUP BY 1)
SELECT event_key, primary_id, source_count, merged_count, least(100.0, floor(top + least(12, (source_count - 1) * 6) + 0.5))::DOUBLE AS score FROM g""")
def event_clusters(spark, d):
    s = scored(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left")
    rows = s.select("id", F.col("site_id").alias("signal"), I.event_key(F.col("title")).alias("event_key"), (-F.coalesce("tier_rank", F.lit(dims.OTHER_RANK))).alias("priority"), (F.col("score") * 100).alias("score"), F.unix_timestamp("event_time").alias("ts"))
    return views.event_clusters(rows)


_STORY = "'story_' || substr(sha1('https://' || site_id || '.example/a?id=' || (id % 500)::VARCHAR), 1, 12)"


@query(f"""WITH {ITEMS}, {TIERS}, r AS (SELECT {_STORY} AS story_id, id, lang AS name, coalesce(tier_rank, 9) AS tier_rank, epoch(event_time)::BIGINT AS ts, coalesce(title, '') AS title, CASE WHEN lang = 'en' THEN 'english' END AS eco FROM items LEFT JOIN tiers USING (site_id))
SELECT story_id, arg_min(id, row(tier_rank, -ts, title, id)) AS primary_id, count(*) AS item_count, count(DISTINCT coalesce(eco, 'item:' || id::VARCHAR)) AS duplicate_count, list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)) AS names, min(ts) AS earliest, max(ts) AS latest FROM r GROUP BY 1""")
def story_records(spark, d):
    t = items(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left")
    rows = t.select(urls.story_id(F.col("url"), F.col("title"), F.col("id")).alias("story_id"), "id", F.col("lang").alias("name"), F.coalesce("tier_rank", F.lit(dims.OTHER_RANK)).alias("tier_rank"), F.unix_timestamp("event_time").alias("ts"), F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("lang") == "en", "english").alias("eco_group"))
    return views.story_records(rows)


@query(f"""WITH {SCORED}, {TIERS}, k AS (SELECT id, coalesce(tier, 'other') AS tier, score, 1 + id % 4 AS duplicates FROM scored LEFT JOIN tiers USING (site_id)),
r AS (SELECT *, list_filter([CASE WHEN tier = 'official' THEN 'official_source' END, CASE WHEN duplicates >= 2 THEN 'multi_source' END, CASE WHEN score >= 0.8 THEN 'high_ai_relevance' END, CASE WHEN score >= 0.75 THEN 'high_importance' END], lambda x: x IS NOT NULL) AS rs FROM k)
SELECT id, CASE WHEN tier = 'official' THEN 'official' WHEN duplicates >= 3 THEN 'multi_source' WHEN score >= 0.72 THEN 'industry' ELSE 'watch' END AS category, CASE WHEN len(rs) > 0 THEN rs ELSE ['recent_ai_signal'] END AS reasons, duplicates >= 2 OR score >= 0.72 AS in_brief FROM r""")
def story_categories(spark, d):
    s = scored(spark, d).join(F.broadcast(tiers(spark)), "site_id", "left").withColumn("tier", F.coalesce("tier", F.lit("other"))).withColumn("n", F.pmod("id", F.lit(4)) + 1)
    score, tier, n = F.col("score"), F.col("tier"), F.col("n")
    return s.select("id", I.category(score, tier, n).alias("category"), I.reasons(score, tier, n, score).alias("reasons"), ((n >= 2) | (score >= dims.BRIEF_AT)).alias("in_brief"))


@query(f"WITH {SCORED}, {TIERS}, c AS (SELECT site_id, count(*) AS n, count(*) FILTER (related) AS k FROM scored GROUP BY 1) SELECT coalesce(t.site_id, c.site_id) AS site_id, coalesce(n, 0) AS raw, coalesce(k, 0) AS kept FROM tiers t FULL JOIN c ON t.site_id = c.site_id")
def site_statistics(spark, d):
    return views.site_stats(scored(spark, d), tiers(spark))


@query(f"""WITH {ITEMS}, k AS (SELECT id, site_id, coalesce(title, '') AS title, 'k' || (id % 50)::VARCHAR AS url_key, epoch(event_time)::BIGINT AS ts FROM items)
SELECT id, site_id FROM k WHERE site_id IS DISTINCT FROM 'src1' UNION ALL
SELECT id, site_id FROM k WHERE site_id = 'src1' QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY contains(lower(title), 'en'), ts DESC, id DESC) = 1""")
def one_item_per_url(spark, d):
    k = items(spark, d).select("id", "site_id", F.coalesce("title", F.lit("")).alias("title"), F.concat(F.lit("k"), F.pmod("id", F.lit(50)).cast("string")).alias("url_key"), F.unix_timestamp("event_time").alias("ts"))
    return views.one_per_url(k, "src1", F.contains(F.lower("title"), F.lit("en"))).select("id", "site_id")


@query(f"""WITH {ITEMS}, o AS (SELECT url, max_by(title, id) AS mate FROM items WHERE lang = 'de' AND title IS NOT NULL GROUP BY 1)
SELECT id, coalesce(CASE WHEN lang = 'de' THEN title END, mate, title) AS title_zh, mate IS NOT NULL AS has_mate FROM items LEFT JOIN o USING (url)""")
def title_mates(spark, d):
    t = items(spark, d).withColumn("key", urls.normalize_url(F.col("url")))
    mates = t.where("lang = 'de' and title is not null").groupBy("key").agg(F.max_by("title", "id").alias("mate"))
    return t.join(mates, "key", "left").select("id", F.coalesce(F.when(F.col("lang") == "de", F.col("title")), "mate", "title").alias("title_zh"), F.col("mate").isNotNull().alias("has_mate"))


@query("""WITH c AS (SELECT o_orderkey AS story_id, ['c' || o_custkey::VARCHAR, 'd' || o_orderdate::DATE::VARCHAR] AS ks, o_orderstatus AS s FROM orders),
taken AS (SELECT DISTINCT unnest(ks) AS k FROM c WHERE s = 'P')
SELECT story_id FROM c WHERE s = 'F' AND NOT list_has_any(ks, (SELECT coalesce(list(k), []) FROM taken))""")
def unseen_stories(spark, d):
    """Orders of status F that share neither customer nor day with one of status P; those of status O take no part."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), "o_orderstatus", F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("d"), F.col("o_orderdate").cast("date").cast("string"))).alias("identity_keys"))
    return views.unseen(c.where("o_orderstatus = 'F'"), c.where("o_orderstatus = 'P'")).select("story_id")


@query(f"WITH {ITEMS} SELECT id, coalesce(len(list_filter(string_split(coalesce(title, ''), ' '), lambda x: x != '')), 0) > 0 AS any_word, least(1.0, (coalesce(regexp_matches(lower(title), '(^|[^a-z0-9])(der)([^a-z0-9]|$)'), false)::INT + coalesce(regexp_matches(lower(title), '(^|[^a-z0-9])(the)([^a-z0-9]|$)'), false)::INT + coalesce(regexp_matches(lower(title), '(^|[^a-z0-9])(para)([^a-z0-9]|$)'), false)::INT) / 3)::DOUBLE AS keyword_score FROM items")
def keyword_scores(spark, d):
    words = F.size(F.filter(F.split(F.coalesce("title", F.lit("")), " "), lambda x: x != "")) > 0
    return items(spark, d).select("id", words.alias("any_word"), I.keyword_score(F.col("title"), ["der", "the", "para"]).alias("keyword_score"))


@query(r"""WITH m AS (SELECT doc_id, nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', 1)), '') AS domain FROM documents)
SELECT doc_id, domain, coalesce(domain = 'example.com' OR ends_with(domain, '.example.com') OR domain = 'org' OR ends_with(domain, '.org'), false) AS allowed FROM m WHERE domain IS NOT NULL""")
def sender_domains(spark, d):
    m = table(spark, d, "documents").select("doc_id", I.mail_domain(F.col("text")).alias("domain")).where("domain is not null")
    return m.select("doc_id", "domain", I.in_domains(F.col("domain"), ["example.com", "org"]).alias("allowed"))


@query("""WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS now, user_id % 400 - 20 AS hours, event_type = 'error' AS forced, CASE WHEN event_type IN ('view', 'click') THEN floor(epoch(ts))::BIGINT - (event_id % 500) * 3600 END AS last FROM events)
SELECT event_id, forced OR CASE WHEN last IS NOT NULL THEN now >= last + greatest(1, least(336, hours)) * 3600 ELSE now % 86400 // 3600 = 5 AND now % 3600 // 60 <= 30 END AS run,
CASE WHEN forced THEN NULL WHEN last IS NOT NULL THEN CASE WHEN now < last + greatest(1, least(336, hours)) * 3600 THEN 'before_run_interval' END WHEN now % 86400 // 3600 = 5 AND now % 3600 // 60 <= 30 THEN NULL ELSE 'outside_initial_window' END AS reason FROM e""")
def run_gates(spark, d):
    now = F.unix_timestamp("ts")
    e = table(spark, d, "events").select("event_id", now.alias("now"), (F.col("user_id") % 400 - 20).alias("hours"), (F.col("event_type") == "error").alias("forced"), F.when(F.col("event_type").isin("view", "click"), now - F.col("event_id") % 500 * 3600).alias("last"))
    return e.select("event_id", gates.run_gate(F.col("forced"), F.col("last"), F.col("hours"), F.col("now"), 5, 30).alias("g")).select("event_id", "g.run", "g.reason")


@query("""SELECT event_id, greatest(0, coalesce(CASE WHEN event_type != 'view' THEN trunc(value) END, 7))::BIGINT AS metric, CASE WHEN floor(epoch(ts))::BIGINT BETWEEN 1356998400 AND 1710000000 THEN floor(epoch(ts))::BIGINT END AS id_time,
CASE WHEN user_id % 10 < 2 THEN 'fresh' WHEN user_id % 10 < 6 THEN 'warn' ELSE 'bad' END AS staleness,
CASE WHEN make_date(2024, 1 + (event_id % 12), 1 + (user_id % 28)) > DATE '2024-06-15' + 2 THEN 2023 ELSE 2024 END AS year FROM events""")
def item_columns(spark, d):
    e, seconds = table(spark, d, "events"), F.unix_timestamp("ts")
    said = F.when(F.col("event_type") != "view", F.format_string(" %,.6f", F.col("value"))).otherwise("n/a")
    note = F.concat(F.lpad(F.lower(F.hex(seconds)), 8, "0"), F.lit("zz"))
    month, day = (F.col("event_id") % 12 + 1).cast("int"), (F.col("user_id") % 28 + 1).cast("int")
    return e.select("event_id", I.metric_count(said, F.lit("7")).alias("metric"), F.unix_timestamp(I.id_time(note, F.timestamp_seconds(F.lit(1710000000)))).alias("id_time"), I.staleness(F.col("user_id") % 10).alias("staleness"), I.year_of(month, day, F.lit("2024-06-15").cast("date")).alias("year"))


_KIND = "CASE " + " ".join(f"WHEN site IN ({', '.join(map(repr, sites))})" + (f" OR tier IN ({', '.join(map(repr, ts))})" if ts else "") + f" THEN '{name}'" for name, sites, ts in I.SOURCE_TYPES) + " ELSE 'aggregate' END"
_SITES = ", ".join(f"('{s}', '{t}', {i})" for i, (s, t, _) in enumerate(dims.TIERS))


@query(f"WITH t(site, tier, i) AS (VALUES {_SITES}), u AS (SELECT user_id, site, tier FROM events LEFT JOIN t ON i = user_id % 26) SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM u GROUP BY 1")
def source_types(spark, d):
    t = spark.createDataFrame([(s, tier, i) for i, (s, tier, _) in enumerate(dims.TIERS)], "site string, tier string, i long")
    u = table(spark, d, "events").withColumn("i", F.col("user_id") % 26).join(F.broadcast(t), "i", "left")
    return u.groupBy(I.source_type(F.col("site"), F.col("tier")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query()
def featured_seats(spark, d):
    s = scored(spark, d).where("related").select("id", "site_id", (F.col("score") >= 0.75).alias("badge"), F.round("score", 1).alias("hot"), (-F.col("score")).alias("place"))
    return views.featured(s)


def _sections_sql(label: str) -> str:
    hits = {"models": f"regexp_matches(content, '{D.MODEL_TERMS}') OR ({label} = 'model_release' AND NOT regexp_matches(whole, '{D.TOOL_TERMS}'))"}
    for name, pattern in D.SECTION_TERMS.items():
        labels = ", ".join(f"'{x}'" for x in D.SECTION_LABELS[name]) or "'?'"
        hits[name] = f"regexp_matches(whole, '{pattern}') OR {label} IN ({labels})"
    hits["community"] += " OR site_id IN (" + ", ".join(f"'{x}'" for x in D.COMMUNITY_SITES) + ") OR " + " OR ".join(f"contains(src, '{x}')" for x in D.COMMUNITY_SOURCES)
    found = "list_filter([" + ", ".join(f"CASE WHEN {hits[x]} THEN '{x}' END" for x in D.SECTIONS) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['industry'] END"


#: Scored documents as readers see them: percentages, priority and sections at the time of the newest one.
SHOWN = f"""{SCORED}, n AS (SELECT max(event_time) AS now FROM items), a AS (SELECT s.*, lower(concat_ws(' ', title, lang, site_id)) AS content, lower(coalesce(lang, '') || ' ') AS src, lang, body FROM scored s JOIN (SELECT id, lang, body FROM items) USING (id)),
b AS (SELECT a.*, concat_ws(' ', content, label) AS whole, CASE WHEN score <= 0 THEN 0.0 ELSE floor(score * 100 + 0.5) END::DOUBLE AS percent, date_diff('second', event_time, now) / 3600.0 AS age FROM a, n),
c AS (SELECT *, CASE WHEN percent > 0 THEN greatest(45.0, floor(percent * 0.72 + 0.5)) ELSE 36.0 END AS editorial, floor(100 * pow(0.5, age / 48.0) + 0.5) AS fresh FROM b),
shown AS (SELECT *, floor(editorial * 0.3 + 38.0 * 0.22 + percent * 0.2 + fresh * 0.18 + 0.5)::DOUBLE AS priority, {_sections_sql('label')} AS sections FROM c)"""


def shown(spark, d):
    s = scored(spark, d).join(items(spark, d).select("id", F.col("lang").alias("source")), "id")
    rows = s.select("id", "site_id", "title", "source", F.col("label").alias("ai_label"), F.col("score").alias("ai_score"), F.col("related").alias("ai_is_related"), F.col("event_time").alias("published_at"))
    now = items(spark, d).agg(F.max("event_time")).first()[0]
    return Q.shown_items(rows, F.lit(now), PROSE)


@query(f"WITH {SHOWN} SELECT id, percent, priority, sections FROM shown WHERE NOT regexp_matches(lower(concat_ws(' ', title, lang)), '{'|'.join(PROSE.unsafe)}')")
def sections(spark, d):
    return shown(spark, d).select("id", "percent", "priority", "sections")


_KEPT = f"kept AS (SELECT *, percent >= 75 OR priority >= 82 AS high FROM shown WHERE related AND NOT regexp_matches(lower(concat_ws(' ', title, lang)), '{'|'.join(PROSE.unsafe)}'))"


@query(f"WITH {SHOWN}, {_KEPT}, g AS (SELECT *, count(*) OVER (PARTITION BY site_id, lang) AS group_size FROM kept) SELECT id, site_id, group_size FROM g ORDER BY group_size DESC, '來源 ' || site_id || ' ' || coalesce(lang, ''), priority DESC, event_time DESC NULLS LAST, id LIMIT 200")
def source_sort(spark, d):
    rows, order = Q.sort_order(Q.mode_items(shown(spark, d), "ai"), "source")
    return rows.orderBy(*order).limit(200).select("id", "site_id", "group_size")


@query(f"""WITH {SHOWN}, {_KEPT}, f AS (SELECT * FROM kept WHERE contains(lower(concat_ws(' ', title, '', '', '', coalesce(lang, ''))), 'e')),
k AS (SELECT *, {EVENT_KEY} AS event_key FROM f) SELECT id, priority FROM k WHERE event_key IN (SELECT event_key FROM k GROUP BY 1 HAVING count(DISTINCT site_id) > 1)""")
def view_query(spark, d):
    rows = shown(spark, d).withColumn("signal", F.col("site_id"))
    return Q.filtered(rows, Q.ViewQuery(text=" E ", level="multi")).select("id", "priority")


@query(f"""WITH {SHOWN}, {_KEPT}, s AS (SELECT section, count(*) AS n, sum(high::INT) AS high, count(DISTINCT coalesce(nullif(lang, ''), site_id)) AS sources FROM (SELECT unnest(['hot'] || sections) AS section, high, lang, site_id FROM kept) GROUP BY 1)
SELECT x AS section, coalesce(n, 0)::BIGINT AS n, coalesce(high, 0)::BIGINT AS high, coalesce(sources, 0)::BIGINT AS sources FROM (SELECT unnest(['hot', 'models', 'products', 'devtools', 'industry', 'research', 'community']) AS x) LEFT JOIN s ON s.section = x""")
def section_statistics(spark, d):
    return Q.section_stats(Q.mode_items(shown(spark, d), "ai"))


_DISPLAY = "CASE WHEN " + _PLAIN.format("t") + " != '' THEN 'title:' || " + _PLAIN.format("t") + " ELSE 'url:' || id::VARCHAR END"


@query(f"""WITH {SHOWN}, {_KEPT}, t AS (SELECT *, coalesce(nullif(lang, ''), '未分割槽') AS source, trim(string_split(trim(coalesce(nullif(title, ''), '未命名更新')), ' / ')[1]) AS t FROM kept), d AS (SELECT *, {_DISPLAY} AS key FROM t),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY site_id, source, key ORDER BY priority DESC, event_time DESC NULLS LAST, id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, source ORDER BY priority DESC) AS r, row_number() OVER (PARTITION BY site_id ORDER BY priority DESC) AS rs FROM o),
g AS (SELECT site_id, source, count(*) AS n, floor(avg(priority) FILTER (r <= 3) + 0.5)::DOUBLE AS value FROM r GROUP BY 1, 2), w AS (SELECT site_id, source, count(*) AS raw_count FROM d GROUP BY 1, 2),
s AS (SELECT site_id, count(*) AS n, floor(avg(priority) FILTER (rs <= 3) + 0.5)::DOUBLE AS value FROM r GROUP BY 1)
SELECT site_id, source, raw_count, n, value FROM g JOIN w USING (site_id, source) UNION ALL SELECT site_id, NULL, (SELECT sum(raw_count) FROM w WHERE w.site_id = s.site_id)::BIGINT, n, value FROM s""")
def source_groups(spark, d):
    return Q.source_groups(Q.mode_items(shown(spark, d), "ai"))


@query(f"WITH {SCORED} SELECT label, count(*) AS items FROM scored WHERE event_time >= (SELECT max(event_time) FROM items) - INTERVAL 14 DAY GROUP BY 1")
def relevance_audit(spark, d):
    s = scored(spark, d)
    now = F.lit(items(spark, d).agg(F.max("event_time")).first()[0])
    return evaluate.audit(s.where(F.col("event_time") >= now - F.make_dt_interval(days=F.lit(14))))["labels"]


@query(f"""WITH {SCORED}, other AS (SELECT id, {sqltext.relevance(OTHER)} FROM (SELECT *, lower(title) AS low FROM items)),
b AS (SELECT a.id, a.related AS was, o.related AS now FROM scored a JOIN other o USING (id) WHERE event_time >= (SELECT max(event_time) FROM items) - INTERVAL 14 DAY)
SELECT count(*) AS items, count(*) FILTER (was) AS kept_before, count(*) FILTER (now) AS kept_after, round(count(*) FILTER (was) / count(*), 4) AS rate_before, round(count(*) FILTER (now) / count(*), 4) AS rate_after, count(*) FILTER (now AND NOT was) AS gained, count(*) FILTER (was AND NOT now) AS lost FROM b""")
def replay_totals(spark, d):
    archive = items(spark, d).select("id", F.col("event_time").alias("published_at"), F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    by = lambda rules: lambda rows: scored(spark, d, rules).join(rows.select("id"), "id", "left_semi")
    now = F.lit(items(spark, d).agg(F.max("event_time")).first()[0])
    return evaluate.replay(archive, by(PROSE), by(OTHER), now, 14)["totals"]


@query()
def overlap_matches(spark, d):
    i = items(spark, d).select("id", "title", "url", F.col("event_time").alias("at"), "site_id")
    mine = F.coalesce(F.col("site_id") == "src1", F.lit(False))
    return evaluate.best_matches(i.where(mine).drop("site_id"), i.where(~mine))


@query()
def diverse_stories(spark, d):
    s = scored(spark, d).select(F.col("id").alias("story_id"), F.col("site_id").alias("source"), story_title().alias("title"), "score")
    return rank.diverse(s, 20)


#: Site rules of words that occur in the tables' prose; the sites' names stand for sources of documents.
SCOPE = scoring.Scope(forwarded=["alpha"], domains=["src9.example"], hot_site="src1", hot_source="24h", board_site="src2", board_allow=["en", "de"], board_block=["de"], media_site="src3", media_trusted=["fr"], media_research=["es"], research=["ch", "ll"], business=["an"], trusted_sites=["src4"])


@query(f"""WITH {ITEMS}, x AS (SELECT *, lower(title) AS lt, CASE WHEN id % 7 = 0 THEN '24h ' ELSE '' END || lang AS src, site_id || '.example' AS host FROM items),
y AS (SELECT *, concat_ws(' ', lt, src, 'site', host) AS low FROM x) SELECT id, {sqltext.site_relevance(PROSE, SCOPE)} FROM y""")
def site_cascade(spark, d):
    source = F.concat(F.when(F.col("id") % 7 == 0, "24h ").otherwise(""), F.col("lang"))
    i = items(spark, d).withColumn("source", source)
    r = scoring.site_relevance(F.col("site_id"), F.col("source"), F.col("title"), F.lit("Site"), F.concat("site_id", F.lit(".example")), F.lit(0.1), PROSE, SCOPE)
    return i.select("id", r.alias("r")).select("id", "r.score", "r.label", "r.related", "r.reason")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 220 THEN rtrim(substr(flat, 1, 217)) || '...' ELSE flat END AS title FROM t""")
def post_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", published.post_title(F.col("text")).alias("title"))


@query(f"""WITH {ITEMS}, n AS (SELECT max(event_time) AS now FROM items), e AS (SELECT site_id AS feed, id AS pos, lower(title) AS link FROM items, n WHERE event_time >= now - INTERVAL 30 DAY),
o AS (SELECT feed, link, min(pos) AS pos FROM e GROUP BY 1, 2) SELECT feed, pos, link FROM o QUALIFY row_number() OVER (PARTITION BY feed ORDER BY pos) <= 8""")
def latest_feed_entries(spark, d):
    i = items(spark, d)
    e = i.select(F.col("site_id").alias("feed"), F.col("id").alias("pos"), F.lower("title").alias("link"), F.col("event_time").alias("published"))
    e = e.join(F.broadcast(i.agg(F.max("event_time").alias("now"))))
    return published.latest_entries(e, F.col("now"), 30, 8).select("feed", "pos", "link")


@query("""WITH m AS (SELECT DISTINCT event_id % 24 AS h, event_id % 60 AS m, event_id % 12 + 1 AS mo, event_id % 28 + 1 AS dy, event_id % 2 = 0 AS clock, event_id, ts FROM events),
c AS (SELECT *, CASE WHEN clock THEN date_trunc('day', ts) + to_hours(h::INT) + to_minutes(m::INT) ELSE make_timestamp(year(ts), mo, dy, 0, 0, 0.0) END AS t FROM m)
SELECT event_id, CASE WHEN clock AND t > ts + INTERVAL 5 MINUTE THEN t - INTERVAL 1 DAY WHEN NOT clock AND t > ts + INTERVAL 2 DAY THEN make_timestamp(year(ts) - 1, mo, dy, 0, 0, 0.0) ELSE t END AS at FROM c""")
def clock_times(spark, d):
    n = lambda m, plus=0: (F.pmod("event_id", F.lit(m)) + plus).cast("string")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(n(24), F.lit(":"), F.lpad(n(60), 2, "0"))).otherwise(F.concat(n(12, 1), F.lit("月"), n(28, 1), F.lit("日")))
    return table(spark, d, "events").select("event_id", times.relative(said, F.col("ts").cast("timestamp")).alias("at"))
