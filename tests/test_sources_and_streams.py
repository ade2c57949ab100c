"""The scanner, trees, stored payloads, the keyed archive and stories in batches against plain versions."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_stories import random_rows

from tidewire.functions import scan
from tidewire.operators import graph, payloads, stories
from tidewire.plans import queries as Q
from tidewire.plans import rendered  # noqa: F401 (registers its queries)
from tidewire.sources import archive_files, catalogue, feeds, pages, payload_source, services
from tidewire.streaming import keyed_archive

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text() | st.sampled_from(['};', '"', "\\", '\\"}', "[{"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=5), inner, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), VALUES, max_size=4), st.text(), st.sampled_from([8, 1 << 16]))
def test_scanner_finds_the_whole_object(value, rest, block):
    whole, scan.BLOCK = scan.BLOCK, block
    try:
        data = json.dumps(value, ensure_ascii=False).encode("utf-8", "surrogatepass")
        text = b"x = " + data + ("; " + rest).encode("utf-8", "surrogatepass")
        assert scan.balanced_end(text, 4) == 4 + len(data)
        assert scan.balanced_end(data[:-1], 0) == -1
    finally:
        scan.BLOCK = whole


def test_embedded_values_of_odd_texts(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [(1, 'a clientVars = {"a": {"b": 1}, "s": "};", "d": 2}; more'), (2, "clientVars: Object({open"), (3, None), (4, ""), (5, "é🙂 clientVars={\"k\": \"é}\"}"), (6, f"clientVars = {deep} "), (7, "clientVars = " + json.dumps({"x": "}" * 500_000}))]
    got = {r.id: r.client_vars for r in payloads.wiki_history(spark.createDataFrame(rows, "id long, payload string")).collect()}
    assert json.loads(got[1]) == {"a": {"b": 1}, "s": "};", "d": 2} and got[2] is None and got[3] is None and got[4] is None
    assert json.loads(got[5]) == {"k": "é}"} and got[6] == deep and len(json.loads(got[7])["x"]) == 500_000
    js = '{v2ex:vL,"hn":{name:"a: b }",home:"x"},\'sspai\':{title:"t"}}'
    held = pages.bundled_sources(spark.createDataFrame([(1, f"var q={js};"), (2, "nothing"), (3, "x={v2ex:vL,open"), (4, None)], "id long, payload string"))
    known = {}
    for r in held.orderBy("id", "pos").collect():
        known.setdefault(r.id, []).append(r.source_id)
    assert known == {1: ["v2ex", "hn", "sspai"], 2: pages.FALLBACK_SOURCES, 3: pages.FALLBACK_SOURCES, 4: pages.FALLBACK_SOURCES}


def test_nearest_marked_nodes_equal_a_climb(spark):
    rng = random.Random(11)
    parent = {n: rng.randrange(n) for n in range(1, 400)} | {n: n - 1 for n in range(1001, 1400)} | {2000: 2001, 2001: 2000, 2002: 2000, 3000: 9999, 3001: 8888}
    marked = set(rng.sample(range(400), 40)) | {1003, 1200, 9999, 2002}
    want = {}
    for n in parent:
        at, up, seen = parent[n], 1, set()
        while at not in marked and at in parent and at not in seen:
            seen.add(at)
            at, up = parent[at], up + 1
        if at in marked:
            want[n] = (at, up)
    nodes = spark.createDataFrame([*parent.items(), (None, 1), (5000, None)], "id long, parent long")
    got = graph.nearest_marked(nodes, spark.createDataFrame([(m,) for m in [*marked, None, 1003]], "id long"))
    assert {r.id: (r.nearest, r.up) for r in got.collect()} == want
    assert graph.nearest_marked(nodes.limit(0), spark.createDataFrame([(1,)], "id long")).count() == 0


def test_nested_values_equal_a_plain_walk(spark):
    rng = random.Random(12)

    def made(level):
        kind = rng.random()
        if level > 4 or kind < 0.3:
            return rng.choice([None, 1, "x", True, 1.5])
        return [made(level + 1) for _ in range(rng.randrange(3))] if kind < 0.6 else {f"k{i}": made(level + 1) for i in range(rng.randrange(3))}

    docs = {n: {"a": made(1), "b": made(1)} for n in range(40)}
    want, shapes = set(), {}

    def walk(n, at, path, level):
        if isinstance(at, dict | list):
            want.add((n, path, len(at) if isinstance(at, dict) else None))
            o, a, d = shapes.get(n, (0, 0, 0))
            shapes[n] = (o + isinstance(at, dict), a + isinstance(at, list), max(d, level))
            for k, v in at.items() if isinstance(at, dict) else enumerate(at):
                walk(n, v, f"{path}.{k}" if isinstance(at, dict) else f"{path}[{k}]", level + 1)

    for n, doc in docs.items():
        walk(n, doc, "$", 1)
    rows = spark.createDataFrame([*((n, json.dumps(doc)) for n, doc in docs.items()), (90, "{"), (91, None), (92, "")], "id long, payload string")
    assert {(r.id, r.path, r.n_keys) for r in services.values_inside(rows, depth=8).collect()} == want
    assert {r.id: (r.objects, r.lists, r.depth) for r in services.payload_shapes(rows, ["id"], depth=8).collect()} == shapes


def test_stored_payloads_are_planned_by_source_and_day(spark, tmp_path):
    for source, day, name, data in [("a", "2026-06-01", "1.xml", b"<rss/>"), ("a", "2026-06-02", "2.xml", "标题".encode("gb18030")), ("b", "2026-06-02", "3.xml", b""), ("b", "2026-06-03", "4.xml", b"x" * 50), ("c", "2026-06-02", "5.xml", "é".encode())]:
        at = tmp_path / f"source={source}" / f"day={day}"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)
    (tmp_path / "source=a" / "day=bad").mkdir()
    (tmp_path / "_SUCCESS").write_text("")
    rows = payload_source.stored_payloads(spark, str(tmp_path), maxBytes=40)
    got = {r.file: (r.source, str(r.day), r.payload, r.error) for r in rows.collect()}
    assert got == {"1.xml": ("a", "2026-06-01", "<rss/>", None), "2.xml": ("a", "2026-06-02", "标题", None), "3.xml": ("b", "2026-06-02", None, "empty"), "4.xml": ("b", "2026-06-03", None, "too large"), "5.xml": ("c", "2026-06-02", "é", None)}
    some = rows.where((F.col("day") >= F.lit("2026-06-02").cast("date")) & F.col("source").isin("a", "b"))
    plan = some._jdf.queryExecution().toString()
    assert {r.file for r in some.collect()} == {"2.xml", "3.xml", "4.xml"} and "Filter" not in plan.split("== Physical Plan ==")[1].replace("RuntimeFilters", ""), plan
    reader = payload_source.PayloadReader({"path": str(tmp_path), "partitionBytes": "1"})
    assert [len(p.files) for p in reader.partitions()] == [1, 2, 1, 1] or sum(len(p.files) for p in reader.partitions()) == 5
    assert {r.source for r in payload_source.stored_payloads(spark, str(tmp_path), ["c"]).collect()} == {"c"}
    told = payload_source.source_statuses(rows, rows.where("payload is not null"))
    assert {r.source: (r.payloads, r.failed, r.errors, r["items"]) for r in told.collect()} == {"a": (2, 0, [], 2), "b": (2, 2, ["empty", "too large"], 0), "c": (1, 0, [], 1)}
    with pytest.raises(Exception, match="nowhere"):
        payload_source.stored_payloads(spark, str(tmp_path / "nowhere")).collect()


def test_keyed_archive_goes_on_and_forgets(spark, tmp_path, monkeypatch):
    day = lambda n: dt.datetime(2026, 6, n)
    columns = "id string, site_id string, title string, summary string, published_at timestamp, seen_at timestamp, ingest_seq int"
    runs = [
        [("a", "s", "one", "told", day(1), day(1), 1), ("b", "opmlrss", "late", None, None, day(1), 2), ("a", "s", "two", None, day(2), day(2), 3), ("old", "s", "t", None, None, day(1), 4)],
        [("a", "s", "three", None, day(3), day(9), 1), ("b", "opmlrss", "late", None, day(8), day(9), 2)],
        [("c", "s", "new", None, None, day(15), 1), ("old", "s", "again", None, None, day(15), 2)],
    ]
    monkeypatch.setattr(keyed_archive, "FOLD_AFTER", 1)
    held = None
    for rows in runs:
        frame = spark.createDataFrame(rows, columns)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        held = {r.id: r for r in keyed_archive.keep(spark, str(tmp_path / "in"), frame.schema, lambda b: b, str(tmp_path / "archive"), 10).collect()}
    assert set(held) == {"a", "b", "c", "old"}
    a, old = held["a"], held["old"]
    assert (a.title, a.summary, a.published_at, a.first_seen_at, a.last_seen_at) == ("three", "told", day(1), day(1), day(9))
    assert held["b"].published_at == day(8) and (old.title, old.first_seen_at) == ("again", day(15))


def test_stories_in_batches_equal_one_run(spark):
    rows = random_rows(13, 120)
    columns = "id long, site_id string, title string, url string, event_time timestamp, tier_rank int, score double"
    frame = spark.createDataFrame(sorted(rows, key=lambda r: r[4]), columns)
    times = sorted(r[4] for r in rows)
    cuts = [times[0], times[40], times[80], times[-1] + dt.timedelta(seconds=1)]
    standing = None
    for lo, hi in zip(cuts, cuts[1:]):
        new = graph.settled(stories.extended_clusters(standing, frame.where((F.col("event_time") >= F.lit(lo)) & (F.col("event_time") < F.lit(hi)))))
        standing = new if standing is None else standing.unionByName(new)
    told = lambda df: {r.id: (r.leader, r.reason, r.similarity) for r in df.collect()}
    assert told(standing) == told(stories.story_clusters(frame))


def test_catalogue_of_known_feeds(spark):
    known = catalogue.known_feeds(spark)
    rows = known.collect()
    assert len({r.feed for r in rows}) == len(rows) == sum(len(g[2]) for g in catalogue.GROUPS)
    now = F.lit("2026-07-24 18:00:00").cast("timestamp")
    rss = "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://v.example/{n}</link><pubDate>Fri, 24 Jul 2026 {n % 10}:00:00 GMT</pubDate></item>" for n, t in enumerate(["GPT news", "Garden news", "AirPods", "An AI chip", *[f"OpenAI {i}" for i in range(9)]])) + "</channel></rss>"
    addresses = {r.source: r.feed for r in rows}
    stored = spark.createDataFrame([(addresses["The Verge"], rss), (addresses["橘鴉AI早報"], rss.replace("GPT news", "2026-07-24")), ("https://unknown.example", rss)], "feed string, payload string")
    got = feeds.catalogue_items(stored, known, now).collect()
    verge = sorted((r.pos, r.title) for r in got if r.source == "The Verge")
    assert [t for _, t in verge] == ["GPT news", "An AI chip", "OpenAI 0", "OpenAI 1", "OpenAI 2", "OpenAI 3"]
    assert "橘鸦AI早报 2026-07-24" in {r.title for r in got if r.site_id == "juya_daily"} and {r.site_id for r in got} == {"curated_media", "juya_daily"}


def test_published_documents_and_run_state(spark, tmp_path):
    (tmp_path / "state").write_text(json.dumps({"sources": {"x_api": {"last_run_at": "2026-07-01T00:00:00Z", "last_ok": True, "last_item_count": 3}}}))
    state = archive_files.read_run_state(spark, str(tmp_path / "state")).collect()
    assert [(r.source, r.last_ok, r.last_item_count, r.last_error) for r in state] == [("x_api", True, 3, None)]
    (tmp_path / "view").write_text(json.dumps({"generated_at": "x", "items": [{"id": "1", "title": "t"}, {"id": "2"}]}))
    assert [(r.id, r.title) for r in archive_files.read_view(spark, str(tmp_path / "view"), "items", "struct<id: string, title: string>").collect()] == [("1", "t"), ("2", None)]
    (tmp_path / "cache").write_text(json.dumps({"Hello": "你好", " ": "x", "Bye": " "}))
    assert [tuple(r) for r in archive_files.read_title_cache(spark, str(tmp_path / "cache")).collect()] == [("Hello", "你好")]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    archive_files.export_document(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_documents_in_batches_keep_every_item(spark, small):
    got = Q.QUERIES["stories_in_batches"](spark, small).collect()
    assert len({r.id for r in got}) == len(got) == spark.read.parquet(f"{small}/documents.parquet").count()


def test_masked_texts_are_restored_and_converted_around_names(spark):
    from tidewire.functions import masking

    rng = random.Random(14)
    letters = ["a", "b", "GPT", "GPT-5", "⟦", "⟧", "0", "p", "⟦0⟧", "⟦p", "\n", "é", "🙂", "$1", "\\", " "]
    texts = ["", None, "GPT-5", "⟦0⟧ GPT", *("".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(300)), "GPT" * 20_000]
    names, phrases = ["GPT", "GPT-5", "é"], {"a": "b", "ab": "X", "b": "$1\\", "0": "zero", "🙂": ""}
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    m = masking.mask(F.col("t"), names)
    got = rows.select("id", "t", m.alias("m"), masking.converted(F.col("t"), phrases, names).alias("c")).select("*", masking.restore(F.col("m.masked"), F.col("m.held")).alias("r")).collect()

    def plainly(text):
        out, table = "", phrases | {n: n for n in names}
        while text:
            found = max((k for k in table if text.startswith(k)), key=len, default=None)
            out, text = out + (table[found] if found else text[0]), text[len(found or " ") :]
        return out

    for r in got:
        assert r.r == r.t
        assert r.c == (None if r.t is None else plainly(r.t) if len(r.t) < 1000 else r.t)
        assert r.t is None or not any(n in r.m.masked for n in names)
    moved = spark.createDataFrame([("⟦1⟧ and ⟦0⟧ ⟦7⟧", ["x", "y"])], "m string, h array<string>")
    assert moved.select(masking.restore(F.col("m"), F.col("h")).alias("r")).first().r == "y and x ⟦7⟧"
    plain = rows.where("t not like '%⟦%' and t not like '%0%'").select(masking.converted_around_names(F.col("t"), {"a": "b", "b": "c"}, names).alias("x"), masking.converted(F.col("t"), {"a": "b", "b": "c"}, names).alias("y"))
    assert all(r.x == r.y for r in plain.collect())
