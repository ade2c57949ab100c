"""Stories, suppression, diverse picks and overlap against plain replays of their definitions."""

import datetime as dt
import hashlib
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.operators import evaluate, rank, similar, stories
from tidewire.plans import dims
from tidewire.plans import queries as Q

NOW = dt.datetime(2026, 6, 2, 12)


def tokens(title):
    plain = re.sub(r"https?://\S+", " ", title.lower())
    return {t for t in re.findall(r"[a-z0-9]+|[一-鿿]{2,}", plain) if t not in dims.TITLE_STOPWORDS and len(t) >= 2}


def alike(a, b):
    ta, tb = tokens(a), tokens(b)
    if not ta or not tb:
        return 0.0
    s, j = SequenceMatcher(None, a, b).ratio(), len(ta & tb) / len(ta | tb)
    return round(max(s, 0.6 * s + 0.4 * j), 4)


def parted(a, b):
    named = lambda t: {v for k, v in dims.VENDORS.items() if k in t}
    modelled = lambda t: {re.sub(r"\s+", "-", m) for m in re.findall(X.MODELS, t)}
    return any(x and y and not x & y for x, y in ((named(a), named(b)), (modelled(a), modelled(b))))


def mergeable(title):
    return len(tokens(title)) >= 4 and len(title.strip()) >= 18


def plain_stories(rows, hours=6.0, threshold=0.86):
    """rows: (id, title, url, time, rank)."""
    leaders, by_url, out = [], {}, {}
    for i, title, url, at, place in sorted(rows, key=lambda r: (r[3], r[4], r[1], r[0])):
        found = by_url.get(url) if url else None
        if found is None and mergeable(title):
            for leader, l_title, l_at in leaders:
                if abs((at - l_at).total_seconds()) <= hours * 3600 and alike(title, l_title) >= threshold and not parted(title, l_title):
                    found = leader
                    break
        if found is None:
            found = i
            leaders.append((i, title, at))
        if url:
            by_url[url] = found
        out[i] = found
    return out


def plain_suppression(rows, hours=6.0, threshold=0.9):
    """rows: (id, site, title, time, rank, score)."""
    out = set()
    for site in {r[1] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[1] == site), key=lambda r: (r[3], r[4], r[2], r[0])):
            t = tokens(r[2])
            for at in range(len(kept) - 1, -1, -1) if mergeable(r[2]) else ():
                o = kept[at]
                u = tokens(o[2])
                if abs((r[3] - o[3]).total_seconds()) > hours * 3600 or not u or len(t & u) < 0.5 * len(t | u) or parted(r[2], o[2]) or alike(r[2], o[2]) < threshold:
                    continue
                if (-r[4], r[5], -r[3].timestamp()) > (-o[4], o[5], -o[3].timestamp()):
                    kept[at] = r
                break
            else:
                kept.append(r)
        out |= {k[0] for k in kept}
    return out


WORDS = "openai claude gpt 4 gpt 5 ships new model for developers today while teams test agents in the cloud 大模型 发布 更新".split()


def random_rows(seed, n):
    rng = random.Random(seed)
    bases = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9))) for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["x"], [t[p], "q"]])
        at = NOW + dt.timedelta(minutes=rng.choice([rng.randint(0, 900), rng.randint(0, 6000), 360]))
        rows.append((i, rng.choice("ab"), "".join(t), rng.choice(["", "", f"u{rng.randint(0, n // 4)}"]), at, rng.randint(0, 3), round(rng.random(), 2)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_stories_and_suppression_equal_plain_replays(spark, seed):
    rows = random_rows(seed, 160)
    frame = spark.createDataFrame(rows, "id long, site_id string, title string, url string, event_time timestamp, tier_rank int, score double")
    got = {r.id: r.leader for r in stories.story_clusters(frame).collect()}
    want = plain_stories([(i, t, u, at, k) for i, _, t, u, at, k, _ in rows])
    assert got == want and len(set(want.values())) < len(want)
    kept = {r.id for r in stories.suppress_near_duplicates(frame).collect()}
    assert kept == plain_suppression([(i, s, t, at, k, sc) for i, s, t, _, at, k, sc in rows]) and len(kept) < len(rows)


def test_story_queries_equal_plain_replays(spark, small):
    i = Q.items(spark, small).withColumn("title", Q.story_title()).select("id", "title", Q.urls.canonical_url(F.col("url")).alias("url"), "event_time").collect()
    got = {r.id: r.leader for r in Q.story_clusters(spark, small).collect()}
    assert got == plain_stories([(r.id, r.title, r.url, r.event_time, 0) for r in i])
    s = Q.scored(spark, small).join(Q.tiers(spark), "site_id", "left").withColumn("title", Q.story_title()).select("id", "site_id", "title", "event_time", F.coalesce("tier_rank", F.lit(9)).alias("r"), "score").collect()
    assert {r.id for r in Q.near_duplicate_titles(spark, small).collect()} == plain_suppression([tuple(r) for r in s])


def test_stories_of_odd_rows(spark):
    columns = "id long, site_id string, title string, url string, event_time timestamp, tier_rank int, score double"
    title = "a title of more than four tokens here"
    rows = [(1, "s", title, None, None, None, None), (2, "s", title, "", NOW, 1, 0.5), (3, None, title, "", NOW, 1, 0.5), (4, "s", None, "u", NOW, 1, 0.5), (5, "s", "", "u", None, 1, 0.5), (6, "s", "短", "", NOW, 1, 0.5)]
    frame = spark.createDataFrame(rows, columns)
    got = {r.id: (r.leader, r.reason) for r in stories.story_clusters(frame).collect()}
    assert got[3] == (2, "title_similarity") and got[1] == (1, None) and got[6] == (6, None) and {got[4][0], got[5][0]} in ({4}, {5})
    assert {r.id for r in stories.suppress_near_duplicates(frame).collect()} == {1, 2, 3, 4, 5, 6}
    assert stories.story_clusters(frame.limit(0)).count() == 0 and stories.suppress_near_duplicates(frame.limit(0)).count() == 0


def test_candidate_titles_lose_no_pair(spark):
    rng = random.Random(4)
    titles = {"".join(rng.choice("abc ") for _ in range(rng.randint(4, 30))) for _ in range(60)} | {r[2] for r in random_rows(9, 80)}
    # long ones, around the length from which titles meet by it
    for size in (500, 512, 515, 900):
        long_ = [rng.choice(WORDS) for _ in range(size // 5)]
        for cut in (0, 3, 9):
            titles.add(" ".join(long_)[cut:size])
    titles = sorted(titles)
    frame = spark.createDataFrame([("", i % 2, t) for i, t in enumerate(titles)], "scope string, band long, title string")
    got = {(r.a, r.b): r.similarity for r in similar.similar_titles(frame, 0.86).collect()}
    want = {(a, b): alike(a, b) for a in titles for b in titles if a != b and alike(a, b) >= 0.86 and not parted(a, b)}
    assert got == want and len(want) > 5


def test_titles_that_must_share_tokens_meet_by_these_alone(spark, monkeypatch):
    titles = sorted({r[2] for seed in (3, 5, 9) for r in random_rows(seed, 80) if r[2]} | {" ".join(WORDS[i % 5 :] + WORDS[: i % 3]) for i in range(9)})
    frame = spark.createDataFrame([("", i % 2, t) for i, t in enumerate(titles)], "scope string, band long, title string")
    sent, held = [], []
    send, settle = spark.sparkContext.broadcast, similar.settled
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(v) or send(v))
    monkeypatch.setattr(similar, "settled", lambda df: held.append(settle(df)) or held[-1])
    for least, jaccard in ((0.9, 0.5), (0.7, 0.8)):
        got = {(r.a, r.b): r.similarity for r in similar.similar_titles(frame, least, jaccard).collect()}
        shared = lambda a, b: bool(tokens(a) and tokens(b)) and len(tokens(a) & tokens(b)) >= jaccard * len(tokens(a) | tokens(b)) - 1e-12
        assert got == {(a, b): alike(a, b) for a in titles for b in titles if a != b and shared(a, b) and alike(a, b) >= least and not parted(a, b)} and got
        assert sent[-1] and all(gram.startswith("t") for gram in sent[-1])
        assert held[-1].where(F.greatest("s.ab", "s.ba") < least).isEmpty()


def test_short_titles_are_not_paired_with_each_other(spark):
    titles = [f"openai note {i}" for i in range(100, 160)] + [f"openai note about the number {i}" for i in range(100, 110)]
    frame = spark.createDataFrame([("", i % 2, t, mergeable(t)) for i, t in enumerate(titles)], "scope string, band long, title string, open boolean")
    got = {(r.a, r.b): r.similarity for r in similar.similar_titles(frame, 0.6).collect()}
    assert got == {(a, b): alike(a, b) for a in titles for b in titles if a != b and alike(a, b) >= 0.6 and (mergeable(a) or mergeable(b))}
    assert any(not mergeable(a) for a, _ in got) and not any(mergeable(a) for a in titles[:60])


def test_suppression_pairs_no_two_short_titles(spark, monkeypatch):
    rows = [(i, "s", f"openai model {i}", "", NOW, 1, 0.5) for i in range(10, 40)] + [(50 + i, "s", "openai model for all of the teams", "", NOW, 1, 0.5) for i in range(2)]
    frame = spark.createDataFrame(rows, "id long, site_id string, title string, url string, event_time timestamp, tier_rank int, score double")
    found = []
    monkeypatch.setattr(stories, "similar_titles", lambda *a: found.append(similar.similar_titles(*a)) or found[0])
    kept = {r.id for r in stories.suppress_near_duplicates(frame).collect()}
    assert kept == plain_suppression([(i, s, t, at, k, sc) for i, s, t, _, at, k, sc in rows]) and len(kept) == 31
    assert found[0].isEmpty()


def test_suppression_meets_every_kept_row_of_the_window(spark):
    one, between, short = (f"alphaalpha bravobravo charliecharlie {end}" for end in ("delta echo", "delt e f g", "d e f g"))
    titles = [one] + [short] * 70 + [one, between]
    rows = [(i, "s", t, "", NOW + dt.timedelta(minutes=i), 1, 0.5) for i, t in enumerate(titles)]
    # Similar in one direction alone, whatever their order as strings.
    x, y = "golf ehtl hotle delta bravo", "golf hotel hotel delta bravo"
    assert alike(one, short) < 0.9 <= min(alike(one, between), alike(between, short)) and alike(x, y) < 0.9 <= alike(y, x)
    rows += [(100, "t", x, "", NOW, 1, 0.5), (101, "t", y, "", NOW + dt.timedelta(minutes=5), 1, 0.5), (102, "u", y, "", NOW, 1, 0.5), (103, "u", x, "", NOW + dt.timedelta(minutes=5), 1, 0.5)]
    frame = spark.createDataFrame(rows, "id long, site_id string, title string, url string, event_time timestamp, tier_rank int, score double")
    kept = {r.id for r in stories.suppress_near_duplicates(frame).collect()}
    assert kept == plain_suppression([(i, s, t, at, k, sc) for i, s, t, _, at, k, sc in rows]) and 71 not in kept and 101 not in kept and {102, 103} <= kept


def test_crowds_of_titles_are_not_paired(spark, monkeypatch):
    """Titles that begin alike are settled without their pairs; leaders are met however many came and went."""
    rng = random.Random(7)
    ends = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3)) for _ in range(60)]
    titles = [f"openai releases new model for developers {e}" for e in ends] + [f"openai releases {e}" for e in ends[:20]]
    rows = [(i, t, "", NOW + dt.timedelta(minutes=12 * i), 0) for i, t in enumerate(titles)]
    found = []
    monkeypatch.setattr(similar, "similar_titles", lambda *a, real=similar.similar_titles: found.append(real(*a)) or found[-1])
    monkeypatch.setattr(stories, "similar_titles", similar.similar_titles)
    frame = spark.createDataFrame(rows, "id long, title string, url string, event_time timestamp, tier_rank int")
    got = {r.id: r.leader for r in stories.story_clusters(frame).collect()}
    assert got == plain_stories(rows) and len(set(got.values())) < len(got) - 20
    assert len(found) == 1 and found[0].isEmpty()
    held = similar.Leaders()
    for i in range(1000):
        late = 300 if i < 600 else 1
        bag = similar.leader_bag(title := f"a title of the number {i}")
        assert [x for x in held.alike(i, late, bag, len(title), 0.1)] == list(range(max(0, i - late), i))
        held.add(i, i, bag, len(title))
    for i in range(2000, 2600):  # all older ones are gone
        assert held.alike(i * 10, 1, bag, len(title), 0.1) == []
        held.add(i, i * 10, bag, len(title))


def plain_diverse(rows, limit):
    """rows: (story_id, source, title, score)."""
    left, picked, used = sorted(rows, key=lambda r: (-r[3], r[2], r[0])), [], {}
    while left and len(picked) < limit:
        best = max(range(len(left)), key=lambda i: (left[i][3] - 0.03 * used.get(left[i][1], 0), -i))
        r = left.pop(best)
        near = lambda a, b: len(tokens(a) & tokens(b)) >= 0.4 * len(tokens(a) | tokens(b)) and alike(a, b) >= 0.86 and not parted(a, b)
        if mergeable(r[2]) and any(near(r[2], p[2]) for p in picked if tokens(p[2])):
            continue
        used[r[1]] = used.get(r[1], 0) + 1
        picked.append(r)
    return [p[0] for p in picked]


@pytest.mark.parametrize("limit", [3, 12])
def test_diverse_stories_equal_the_greedy_pick(spark, limit):
    rows = [(i, s, t, sc) for i, s, t, _, _, _, sc in random_rows(5, 150)] + [(900 + i, "one", f"steady headline number {i} about quite different matters {i * 7}", 0.99) for i in range(60)]
    got = rank.diverse(spark.createDataFrame(rows, "story_id long, source string, title string, score double"), limit).orderBy("place").collect()
    assert [r.story_id for r in got] == plain_diverse(rows, limit)
    assert rank.diverse(spark.createDataFrame([], "story_id long, source string, title string, score double"), limit).count() == 0


def test_overlap_equals_plain_comparison(spark):
    norm = lambda t: " ".join(w for w in re.sub(r"[^a-z0-9一-鿿]+", " ", re.sub(r"\b20\d{2}\b", " ", t.lower())).split() if w not in X.DROP_WORDS)
    rows = random_rows(7, 90)
    a, b = rows[:30], rows[30:]
    want = {}
    for i, _, t, u, at, _, _ in a:
        found = []
        same = [o for o in b if u and o[3] == u]
        for o in same or b:
            x, y = norm(t), norm(o[2])
            score = 1.0 if same else similar.overlap_similarity(x, y)
            if same:
                kind = "url_exact"
            elif not set(w for w in x.split() if len(w) > 1) & set(w for w in y.split() if len(w) > 1):
                continue
            elif x == y and t.lower().strip() == o[2].lower().strip():
                kind = "title_exact"
            elif score >= 0.88:
                kind = "title_similarity"
            elif score >= 0.62 and set(x.split()) & set(y.split()) & set(X.ENTITIES) and abs((at - o[4]).total_seconds()) <= 2 * 86400:
                kind = "entity_time_possible"
            else:
                continue
            found.append((kind != "entity_time_possible", score, -o[0], kind))
        if found:
            hard, score, other, kind = max(found)
            want[i] = (-other, kind, score, hard)
    columns = "id long, site_id string, title string, url string, at timestamp"
    frame = lambda part: spark.createDataFrame([(i, s, t, f"http://x/{u}" if u else "", at) for i, s, t, u, at, _, _ in part], columns)
    matches = evaluate.best_matches(frame(a), frame(b))
    got = {r.id: (r.other, r.match_type, r.score, r.hard) for r in matches.collect()}
    assert got == want and len({k for _, k, _, _ in want.values()}) >= 3
    report = evaluate.overlap_report(frame(a), matches).first()
    assert report["items"] == 30 and report.duplicates == sum(v[3] for v in want.values()) and report.unique == 30 - len(want)


def test_literal_cases_equal_their_sql(spark, small):
    import duckdb

    import literal_news as L
    import literal_reader  # noqa: F401 (registers its cases)

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    assert len(L.SQL) > 30
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list | tuple) else round(v, 6) if isinstance(v, float) else v
    for name in L.SQL:
        got = L.QUERIES[name](spark, small)
        cols = sorted(got.columns)
        want = con.execute(L.SQL[name])
        at = [[d[0] for d in want.description].index(c) for c in cols]
        assert sorted(map(repr, (plain(tuple(r[c] for c in cols)) for r in got.collect()))) == sorted(map(repr, (plain(tuple(r[i] for i in at)) for r in want.fetchall()))), name


def test_overlap_candidates_are_few_and_lose_no_copy(spark):
    """Prose of one vocabulary shares its rarest character pairs, so all of it used to meet."""
    r = random.Random(5)
    said = lambda n: " ".join("".join(r.choice("th ing tion an re he nd on ou qu zi xk".split()) for _ in range(r.randint(1, 4))) for _ in range(n))

    def edited(t):
        for _ in range(r.randint(0, len(t) // 12)):
            p = r.randrange(len(t))
            t = t[:p] + r.choice(["", "q", "an"]) + t[p + 1 :]
        return " ".join(t.split()) or "x"

    a = [said(r.choice([1, 4, 12, 40, 90])) for _ in range(60)]
    b = [edited(t) for t in a for _ in range(2)] + [said(r.choice([12, 40])) for _ in range(80)]
    frame = lambda rows, name: spark.createDataFrame([(t, None) for t in rows], f"{name} string, at timestamp")
    got = {(x.norm, x.o_norm) for x in similar.overlap_candidates(frame(a, "norm"), frame(b, "o_norm").withColumnRenamed("at", "o_at"), 0.88, 2).collect()}
    shared = lambda x, y: any(len(t) > 1 for t in set(x.split()) & set(y.split()))
    want = {(x, y) for x in a for y in b if shared(x, y) and similar.overlap_similarity(x, y) >= 0.88}
    assert len(want) > 40 and want <= got and len(got) < 4 * len(want)
    scored = spark.createDataFrame(sorted(got), "a string, b string").withColumn("s", similar.overlap_similarities("a", "b", F.lit(0.88)))
    assert {(x.a, x.b): x.s for x in scored.where("s >= 0.88").collect()} == {p: similar.overlap_similarity(*p) for p in want}


def test_token_overlap_shuffles_no_strings_for_each_token(spark):
    r = random.Random(4)
    words = [hashlib.sha512(str(i).encode()).hexdigest() for i in range(400)]
    rows = lambda n, at: spark.createDataFrame([(at + i, r.sample(words, 60)) for i in range(n)], "id long, tokens array<string>")
    a, b = rows(20, 0), rows(200, 1000)

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to be broadcast
    try:
        before = written()
        assert evaluate.token_overlap(a, b).count() == 0
        # The sets' strings are 1.7 MB; a copy of a set for each of its tokens would be 60 times that.
        assert 0 < written() - before < 15_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_short_texts_are_left_out_by_short_runs(monkeypatch):
    """Texts of one language under 200 characters: bounds by runs leave few pairs for the common subsequence, and no pair is lost."""
    rng = random.Random(11)
    parts = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r"]) for _ in range(60)]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(28))[:160] for _ in range(60)]
    texts += [t[:i] + "x" + t[i + 3 :] for i, t in enumerate(texts[:20])]
    counted = []
    monkeypatch.setattr(similar, "longest_common", lambda a, b, real=similar.longest_common: counted.append(1) or real(a, b))
    got = {tuple(p) for p in similar.alike_in_block(texts, texts, 0.8795).tolist()}
    met, want = len(counted), {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if SequenceMatcher(None, a, b).ratio() >= 0.8795}
    assert want <= got and len(want) >= 120 and met < 500


def test_token_overlap_equals_a_plain_search(spark):
    r = random.Random(8)
    sets = lambda n, at: [(at + i, sorted({f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 9))})) for i in range(n)]
    a, b = sets(60, 0), sets(150, 1000)
    want = {}
    for i, x in a:
        alike = [(len(set(x) & set(y)) / len(set(x) | set(y)), -j) for j, y in b if x and y]
        if alike and max(alike)[0] >= 0.5:
            want[i] = (-max(alike)[1], max(alike)[0])
    frame = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    assert {x.id: (x.other, x.jaccard) for x in evaluate.token_overlap(frame(a), frame(b)).collect()} == want and len(want) > 5
