"""Chat formatting, pseudo-likelihood, passages, embeddings and WARC against plain versions."""

import base64
import gzip
import hashlib
import json
import random

import numpy as np
import pytest

pytest.importorskip("tidewire.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidewire.llm import chat_format, embed_dedup, pseudo_lm, queries, substring_dedup, warc  # noqa: E402


def test_chat_query_equals_plain_version(spark, small):
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, small).collect()}
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", queries.TRICKY), (1, "assistant", queries.TRICKY)]
    assert set(got) == set(turns)
    for k, rows in turns.items():
        rows = [(role, text) for _, role, text in sorted(rows)]
        loss = "".join(t for role, t in rows if role == "assistant")
        assert got[k].n_turns == len(rows)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == len(chat_format.formatted(rows)[0])


def test_chat_layouts_and_odd_records(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "<|im_end|>\\"}, {"from": "gpt", "value": "é\\p<|<\\p"}]})),
        (3, json.dumps({"instruction": "do", "input": "", "output": "done"})),
        (4, json.dumps({"unknown": {"layout": [1]}})),
        (5, "no json"),
        (6, None),
        (7, json.dumps({"messages": []})),
        (8, json.dumps({"prompt": "x" * 200_000, "response": "y\n<|im_start|>"})),
        (8, json.dumps({"prompt": "x" * 200_000, "response": "y\n<|im_start|>"})),
        (None, json.dumps({"question": "q", "answer": "a"})),
    ]
    frame = spark.createDataFrame([(*r, "extra") for r in records], "id long, rec string, chat string")
    made = chat_format.format_chats(frame, "id", "rec")
    layouts = {r.id: r.layout for r in made.collect()}
    assert layouts == {1: "messages", 2: "exchange", 3: "instruction", 4: None, 5: None, 6: None, 7: "empty_messages", 8: "prompt", None: "question"}
    back = {r.id: r for r in chat_format.parse_chats(made, "id").collect()}
    assert [tuple(t) for t in back[1].turns] == [("system", "s"), ("user", "")]
    assert [tuple(t) for t in back[2].turns] == [("user", "<|im_end|>\\"), ("assistant", "é\\p<|<\\p")] and back[2].loss_text == "é\\p<|<\\p"
    assert [tuple(t) for t in back[3].turns] == [("user", "do"), ("assistant", "done")]
    assert back[4].turns is None and back[7].turns == [] and back[8].loss_text == "y\n<|im_start|>"
    assert chat_format.format_chats(frame.limit(0), "id", "rec").count() == 0


def test_chat_escaping_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        turns = [("".join(rng.choice("\\<|p\nn>") for _ in range(rng.randint(0, 6))), "".join(rng.choice(["\\", "<|", "p", "\n", "<|im_end|>", "<", "|"]) for _ in range(rng.randint(0, 8)))) for _ in range(3)]
        assert chat_format.read_back(chat_format.formatted(turns)[0]) == turns


def brute_embeddings(rows, cosine=0.9):
    """(key, links, component) by comparing all with all."""
    x = [np.array(v, float) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) else None for _, v in rows]
    x = [v / np.abs(v).max() if v is not None else None for v in x]
    near = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= cosine for j in range(len(x))] for i in range(len(x))]
    comp = list(range(len(x)))
    for i in range(len(x)):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        comp[i] = min(rows[j][0] for j in seen)
    return [(k, sum(n), c) for (k, _), n, c in zip(rows, near, comp)]


@pytest.mark.parametrize("small_length", [1 << 17, 100])
def test_embeddings_equal_brute_force(spark, monkeypatch, small_length):
    monkeypatch.setattr(embed_dedup, "SMALL", small_length)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05 * (i % 11)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(20)] + [(330, [0.0] * 8), (331, None), (332, [None] + [1.0] * 7), (333, [float("nan")] * 8), (334, [1.0]), (335, [float("inf")] * 8), (336, (np.array(rows[5][1]) * 1e200).tolist())]
    # other lengths, with links of their own
    rows += [(340, [3.0]), (341, [0.5]), (342, [-1.0]), (343, []), *((350 + i, (np.arange(1, 41) + rng.normal(size=40) * 3).tolist()) for i in range(30))]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, raw int, n int")
    for block in (16, 1024) if small_length == 100 else (None,):
        got = embed_dedup.near_duplicates(frame, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_embeddings(rows))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(frame.where("vec_id = 331")).collect()[0].n_links == 0


def test_embedding_query_equals_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert {r.vec_id: r.n_links for r in queries.op8_embedding_dedup(spark, small).collect()} == {k: n for (k, _), n in zip(rows, links)}


def test_warc_query_and_odd_pages(spark, small, tmp_path):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {}
    for k, t in pages.items():
        last[digest(t)] = max(k, last.get(digest(t), k))
    got = {r.page_id: tuple(r)[1:] for r in queries.op9_warc(spark, small).collect()}
    assert got == {k: (len((t or "").encode()), digest(t), "response" if last[digest(t)] == k else "revisit", None if last[digest(t)] == k else last[digest(t)]) for k, t in pages.items()}

    odd = [(1, "http://A.example/x\r\ny", "a\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, None), (3, "not a url", ""), (3, "not a url", ""), (4, "http://[bad", "é" * 100_000), (None, "http://www.a.example:80/", "é" * 100_000), (None, "u", "alone")]
    frame = spark.createDataFrame([(*r, 0) for r in odd], "page_id long, url string, html string, payload_bytes int")
    warc.write_archives(warc.deduplicated(frame), str(tmp_path / "w"))
    rows = warc.read_captures(spark, str(tmp_path / "w")).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert kinds == sorted([("1", "response", None, 17), ("2", "revisit", 3, 0), ("3", "response", None, 0), ("3", "response", None, 0), ("4", "response", None, 200_000), ("None", "revisit", 4, 200_000), ("None", "response", None, 5)])
    small_kept = warc.deduplicated(frame, least_bytes=1).where("payload_bytes = 0").select("record_type").distinct().collect()
    assert [r[0] for r in small_kept] == ["response"]
    bodies = [b.split(b"\r\n\r\n", 1)[1] for f in (tmp_path / "w").glob("*.gz") for h, b in warc.parse_archive(f.read_bytes()) if h["WARC-Type"] == "response"]
    assert sorted(bodies) == sorted((t or "").encode() for k, _, t in odd if k != 2 and not (k is None and t[0] == "é"))
    warc.write_archives(warc.deduplicated(frame.limit(0)), str(tmp_path / "none"))
    assert warc.merged_index(warc.read_captures(spark, str(tmp_path / "none"))).count() == 0


def test_warc_reader_takes_members_and_finds_damage():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_archive(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_archive(one.replace(b": 3", b": 2")))


def test_merged_index_splits_captures_that_agree(spark):
    rows = [(None, "http://a/", "com,a)/", "2026", "response", f"D{i % 3}", 1, None, f"run{i % 7}", i) for i in range(8000)]
    merged = warc.merged_index(spark.createDataFrame(rows, warc.CAPTURES), range_rows=200)
    parts = merged.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in parts) == 8000 and max(r.n for r in parts) < 1000
    got = [(r.payload_digest, r.run, r.seq) for r in merged.collect()]
    assert got == sorted(got)


def test_merged_index_is_in_global_order(spark):
    rng = random.Random(9)
    rows = []
    for run in range(13):
        captures = [(rng.choice([None, *range(90)]), "u", rng.choice(["com,a)/", "com,a)/hot", "org,b)/"]), f"2024-01-{rng.randint(1, 28):02}", "response", "d", 1, None) for _ in range(rng.randint(1, 60))]
        rows += [(*c, f"run{run}", i) for i, c in enumerate(sorted(captures, key=warc.capture_order))]
    frame = spark.createDataFrame(rows, warc.CAPTURES)
    merged = [tuple(r)[:6] for r in warc.merged_index(frame, range_rows=50).collect()]
    assert len(merged) == len(rows)
    assert [warc.capture_order(r) for r in merged] == sorted(warc.capture_order(r) for r in rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 20):
        runs = [sorted((rng.randint(0, 50),) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_pseudo_likelihood_tells_language_from_noise(spark):
    rng = random.Random(6)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("lang = 'en'").limit(600).collect()
    model = pseudo_lm.train(spark.createDataFrame(rows[:450], "doc_id long, text string"))
    assert len(model.flat) == pseudo_lm.SIZE
    held = [r.text for r in rows[450:] if len(r.text.split()) > 80]
    shuffled = []
    for t in held:
        w = t.split()
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    letters = [" ".join("".join(rng.sample(w, len(w))) for w in t.split()) for t in held]
    frame = spark.createDataFrame(list(enumerate(held + shuffled + letters)), "doc_id long, text string")
    mean = {r.doc_id: r.score for r in pseudo_lm.score(frame, model).collect()}
    n = len(held)
    untrained = {r.doc_id: r.score for r in pseudo_lm.score(frame, pseudo_lm.Model(model.common, pseudo_lm.started())).collect()}
    assert np.mean([mean[i] - mean[2 * n + i] for i in range(n)]) > 0.5
    assert np.mean([mean[i] - mean[n + i] for i in range(n)]) > 0.0
    assert np.mean([mean[i] - untrained[i] for i in range(n)]) > 0.5


def plain_log_probability(p, ids, k):
    """One token's log-probability by the definition."""
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    side = lambda name, at: p[name][ids[at] if 0 <= at < len(ids) else pseudo_lm.OUTSIDE]
    h = sum(side("left", k - d) + side("right", k + d) for d in (1, 2))
    x = ids[k]
    parts = [(0, 0, x >> 10), (1, x >> 10, (x >> 5) & 31), (2, x >> 5, x & 31)]
    return sum(np.log(soft(h @ p[f"out{n}"] + p[f"bias{n}"][row])[digit]) for n, row, digit in parts)


def test_pseudo_likelihood_sums_plain_probabilities(spark):
    rng = np.random.default_rng(2)
    words = "one a b c d e f".split()
    hashes = [pseudo_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in words]
    model = pseudo_lm.Model(np.array(hashes[:4], np.uint64), rng.normal(size=pseudo_lm.SIZE).astype(np.float32))
    p = pseudo_lm.parameters(model.flat)
    texts = [None, "", "one", "a b  c\nd e f", "x " * 20_000]
    got = {r.doc_id: r for r in pseudo_lm.score(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, mean int"), model).collect()}
    number = {w: i if i < 4 else pseudo_lm.COMMON + int(h) % pseudo_lm.RARE for i, (w, h) in enumerate(zip(words, hashes))}
    for i, t in enumerate(texts[:4]):
        ids = [number[w] for w in (t or "").split()]
        assert got[i].n_tokens == len(ids)
        assert got[i].log_likelihood == pytest.approx(sum(plain_log_probability(p, ids, k) for k in range(len(ids))), rel=1e-3, abs=1e-6)
    assert got[0].score is None and got[4].n_tokens == 20_000
    assert pseudo_lm.pseudo_likelihood(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.5, pseudo_lm.SIZE)
    ids = rng.choice([5, 40, 1029, 65_000], 30)
    rows = np.array([0, 12, 12, 30])
    loss = lambda: -pseudo_lm.log_probabilities(pseudo_lm.parameters(flat), ids, rows).mean()
    p, got = pseudo_lm.parameters(flat), pseudo_lm.gradients(pseudo_lm.parameters(flat), ids, pseudo_lm.contexts(ids, rows))
    for k, (at, grad) in got.items():
        dense = np.zeros(pseudo_lm.SHAPES[k])
        dense[at] = grad
        for _ in range(6):
            r, c = rng.choice(np.arange(len(dense))[at]), rng.integers(dense.shape[1])
            kept = p[k][r, c]
            p[k][r, c] = kept + 1e-5
            up = loss()
            p[k][r, c] = kept - 1e-5
            assert dense[r, c] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            p[k][r, c] = kept


def test_training_doesnt_depend_on_partitions(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(None, None), (None, "a b c"), (None, "a b c")]
    frame = lambda rows, n: spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
    one, other = (pseudo_lm.train(f) for f in (frame(rows, 2), frame(rows[::-1], 7)))
    assert (one.common == other.common).all()
    assert np.abs(one.flat - other.flat).max() < 1e-3
    assert np.abs(one.flat - pseudo_lm.started()).max() > 0.1


def test_compact_windows_stand_for_each_passage_once():
    rng = np.random.default_rng(3)
    for n in (0, 3, 10, 40):
        h = rng.integers(0, 12, n)
        found = substring_dedup.compact_windows(h, 4)
        for i in range(n):
            for j in range(i + 3, n):
                holding = sorted(c for lo, c, hi in found if lo <= i <= c <= j <= hi)
                assert holding == (i + np.flatnonzero(h[i : j + 1] == h[i : j + 1].min())).tolist()


def planted_passages(rng, share):
    """Documents of random words; ``share`` gives (documents that hold the passage, its words, edits)."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    docs = [[word() for _ in range(rng.randint(60, 300))] for _ in range(120)]
    truth = []
    for holders, size, edits in share:
        text = [word() for _ in range(size)]
        for d in holders:
            copy = list(text)
            for e in range(edits if d != holders[0] else 0):
                copy[(e * 2 + 1) * size // (2 * edits)] = word()
            at = rng.randint(0, len(docs[d]))
            docs[d][at:at] = copy
        truth.append(holders)
    return [(i, " ".join(w)) for i, w in enumerate(docs)], truth


def test_passages_of_documents_are_found_and_clean_ones_left(spark):
    rng = random.Random(11)
    share = [([1, 2], 51, 0), ([3, 4, 5, 6, 7, 8, 9], 60, 0), ([10, 20], 300, 2), ([30, 31, 32], 55, 0), ([40, 41], 120, 1), ([50, 51], 30, 0)]
    rows, truth = planted_passages(rng, share)
    rows += [(200, rows[60][1]), (201, rows[60][1].upper()), (202, None), (203, ""), (None, rows[61][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, a int, k int")
    got = substring_dedup.near_passages(frame).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 and r.doc_id > r.other_doc_id for r in got)
    connected = {x for p in pairs for x in p}
    for holders in truth[:-1]:
        assert set(holders) <= connected
        assert all(any({a, b} <= set(holders) for a, b in pairs if d in (a, b)) for d in holders)
    assert connected == {d for h in truth[:-1] for d in h} | {60, 200, 201}
    words = {k: t.lower().split() for k, t in rows if t}
    exact = next(r for r in got if (r.doc_id, r.other_doc_id) == (2, 1))
    assert words[2][exact.start_word : exact.end_word][:40] == words[1][exact.other_start : exact.other_end][:40]
    assert substring_dedup.near_passages(frame.limit(0)).count() == 0


def test_passages_the_first_and_last_holders_of_a_phrase_lack(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    noise = lambda n: [word() for _ in range(n)]
    docs, truth = {i: [] for i in range(40)}, set()
    for n in range(8):
        phrase = noise(18)
        first, second = ([*noise(30), *phrase, *noise(30)] for _ in range(2))
        for i, middle in enumerate([[]] * 4 + [first] * 2 + [second] * 3 + [[]] * 4):
            docs[(n + i) % 40] += noise(5) + (middle or noise(40) + phrase + noise(40)) + noise(5)
        truth |= {(n + 5, n + 4), (n + 7, n + 6), (n + 8, n + 6)}
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # pairs that share a long passage, by brute force
    held = {i: {tuple(w[j : j + 50]) for j in range(len(w) - 49)} for i, w in docs.items()}
    share = {(a, b) for a in held for b in held if a > b and held[a] & held[b]}
    assert truth <= share and got <= share and truth <= got


def test_equal_intervals_have_equal_hashes():
    values = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    lo = np.arange(0, 290)
    got = substring_dedup.interval_hashes(values, lo, lo + 3)
    assert len(set(got.tolist())) == len({tuple(values[i : i + 4].tolist()) for i in lo})


def test_passages_with_one_word_inserted(spark):
    rng = random.Random(12)
    rows, _ = planted_passages(rng, [])
    base = [f"w{i}" for i in range(70)]
    rows += [(300, " ".join(base)), (301, " ".join(base[:35] + ["new"] + base[35:]))]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(301, 300)}


def test_edited_copies_of_a_passage_meet_the_unchanged_one(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    texts = {0: None}
    for i in range(200):
        edited = list(passage)
        edited[10 + i % 40] = f"edit{i}"
        texts[i + 1] = edited
    # The unchanged one stands in the middle of the keys, the least and the greatest are edited copies.
    texts[0], texts[100] = texts[100], list(passage)
    rows = [(k, " ".join(rng.choices(words, k=30) + t + rng.choices(words, k=30))) for k, t in texts.items()]
    rows += [(1000 + k, " ".join(rng.choices(words, k=80))) for k in range(20)]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: {tuple(t[i : i + 5]) for i in range(56)} for k, t in texts.items()}
    wanted = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {k: k for k in texts}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in got:
        assert a < 1000 and b < 1000
        group[top(a)] = top(b)
    joined = sum(top(a) == top(b) for a, b in wanted)
    assert joined >= 0.97 * len(wanted), (joined, len(wanted))


def test_forest_joins_what_brute_force_joins():
    rng = np.random.default_rng(3)
    least, zone = substring_dedup.LEAST, substring_dedup.ZONE
    base = rng.integers(1, 1 << 16, 2 * zone + 1).astype("<u2")
    rows = []
    for _ in range(60):
        x = rng.integers(1, 1 << 16, len(base)).astype("<u2")
        lo = zone - int(rng.integers(0, least + 20))
        hi = min(len(x), lo + least + int(rng.integers(0, 30)))
        x[lo:hi] = base[lo:hi]
        gap = int(rng.integers(lo, hi - 5))
        if not gap <= zone < gap + 5:
            x[gap : gap + 5] = rng.integers(1, 1 << 16, 5)
        rows.append(x)
    rows = np.array(rows)

    def plain(x, y):
        same = x == y
        spans = [(b, e) for b in range(zone + 1) for e in range(max(zone + 1, b + least), len(x) + 1) if same[b] and same[e - 1]]
        return any(9 * int(same[b:e].sum()) >= 8 * (e - b) for b, e in spans)

    for i in (0, 7, 31):
        assert [bool(v) for v in substring_dedup.alike_around(rows[i], rows)] == [plain(rows[i], y) for y in rows]
    pairs = substring_dedup.forest(rows)
    assert pairs and len(pairs) < len(rows)


def test_passage_is_the_longest_similar_stretch():
    rng = np.random.default_rng(11)
    least = substring_dedup.LEAST
    for _ in range(60):
        a = np.arange(120, dtype=np.uint64)
        b = a + np.uint64(1000)
        lo, hi = 20 + int(rng.integers(0, 20)), 75 + int(rng.integers(0, 25))
        b[lo:hi] = a[lo:hi]
        for _ in range(int(rng.integers(0, 3))):
            gap = int(rng.integers(lo, hi - 5))
            b[gap : gap + 5] += np.uint64(5000)
        at = int(rng.choice(np.flatnonzero(a == b)))
        same = a == b
        spans = [e - s for s in range(at + 1) for e in range(at + 1, 121) if same[s] and same[e - 1] and 9 * int(same[s:e].sum()) >= 8 * (e - s)]
        got = substring_dedup.passage(substring_dedup.side_by_side(a, b, 0), at, 0)
        assert (got[1] - got[0] if got else 0) == (max(spans) if max(spans) >= least else 0)


def test_pseudo_likelihood_is_of_words_not_of_their_ids(spark):
    rest = lambda w: int(pseudo_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) % pseudo_lm.RARE
    often = "often"
    seldom = next(w for w in (f"seldom{i}" for i in range(100_000)) if rest(w) == rest(often))
    # so many more frequent words that these two have no ids of their own
    filler = [" ".join(f"w{i}" for i in range(pseudo_lm.COMMON + 10))] * 8
    texts = [f"w1 w2 {often} w3 w4"] * 4 + [f"w1 w2 {seldom} w3 w4", None, "", *filler]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudo_lm.pseudo_likelihood(frame).collect()}
    assert len(got) == len(texts)
    assert got[0].log_likelihood - got[4].log_likelihood == pytest.approx(np.log(4), abs=1e-3)
    assert got[4].score == pytest.approx(got[4].log_likelihood / 5)
    assert [(got[i].n_tokens, got[i].log_likelihood, got[i].score) for i in (5, 6)] == [(0, 0, None)] * 2


def test_chat_records_that_look_like_a_layout(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user"}, {"content": "x"}]})),
        (2, json.dumps({"messages[].role": "user", "messages[].content": "x"})),
        (3, '{"prompt": "\\ud800", "response": "x"}'),
        (4, '{"a": ' * 100_000 + "1" + "}" * 100_000),
        (5, json.dumps({"turns": [{"turn": 0, "role": "human", "text": "as it is"}]})),
        (6, json.dumps({"messages": [["role", "content"]]})),
        (7, '{"\\ud800": 1}'),
        (8, json.dumps({"conversations": [{"from": "human", "value": "hi"}]})),
    ]
    made = chat_format.format_chats(spark.createDataFrame(records, "id long, rec string"), "id", "rec")
    assert {r.id: r.layout for r in made.collect()} == {1: None, 2: None, 3: None, 4: None, 5: "rows", 6: None, 7: None, 8: "exchange"}
    back = {r.id: r.turns for r in chat_format.parse_chats(made, "id").collect()}
    assert back[5][0].role == "human" and back[8][0].role == "user" and back[1] is None


def near_by_brute_force(a, b):
    """Whether two texts share a passage of 50 words or more with a similarity of 0.8, side by side at any offset."""
    x, y = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (a, b))
    for shift in range(-len(x), len(y)):
        lo, hi = max(0, -shift), min(len(x), len(y) - shift)
        sums, low = 0, {}
        equal = [x[i] == y[i + shift] for i in range(lo, hi)]
        before = [0]
        for e in equal:
            sums += 1 if e else -8
            before.append(sums)
        least = float("inf")
        for end in range(substring_dedup.LEAST, len(before)):
            least = min(least, before[end - substring_dedup.LEAST])
            if before[end] >= least:
                return True
    return False


def test_near_passages_have_full_recall_on_edited_copies(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows, sources = [], [[word() for _ in range(n)] for n in (50, 52, 60, 75, 100, 140)]
    for i in range(60):
        copy = list(sources[i % 6])
        for _ in range(rng.randint(0, 1 + len(copy) // 60)):
            p = rng.randrange(len(copy))
            copy[p : p + 1] = [word()]
        rows.append((i, [word() for _ in range(rng.randint(0, 40))] + copy + [word() for _ in range(rng.randint(0, 40))]))
    near = {(a, b) for a, x in rows for b, y in rows if a > b and near_by_brute_force(x, y)}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.near_passages(frame).collect()}
    assert got <= near and len(near) > 100

    def rooted(pairs):
        top = {k: k for k, _ in rows}
        for _ in rows:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    # the links given connect all that any link connects
    assert rooted(got) == rooted(near)


def test_passages_with_two_words_inserted_or_deleted(spark):
    rows = []
    for n in range(8):
        base = [f"w{n}x{i}" for i in range(50)]
        longer = base[: 20 + n] + ["new", f"newer{n}"] + base[20 + n :]
        one, two = (longer, base) if n % 2 else (base, longer)
        rows += [(10 * n + 1, " ".join(one)), (10 * n, " ".join(two))]
    got = {(r.doc_id, r.other_doc_id) for r in substring_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 42 of at most 52 shingles are shared wherever an untouched run of 21 is left
    assert got == {(10 * n + 1, 10 * n) for n in range(8) if max(20 + n, 30 - n) >= 25}


def test_each_document_has_the_class_of_all_its_links(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows, source = [], [word() for _ in range(60)]
    for i in range(40):
        copy = list(source)
        for p in rng.sample(range(len(copy)), i % 3):
            copy[p] = word()
        rows.append((i, [word() for _ in range(20)] + copy + [word() for _ in range(20)]))
    rows += [(100 + i, [word() for _ in range(90)]) for i in range(5)]
    near = [(a, b) for a, x in rows for b, y in rows if a > b and near_by_brute_force(x, y)]
    least = {k: k for k, _ in rows}
    for _ in rows:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(200, None), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.passage_classes(frame).collect()}
    assert {k: r.component_id for k, r in got.items()} == least | {200: 200} and len(near) > 100
    assert all(p.other_doc_id < k and p.end_word - p.start_word >= 50 for k, r in got.items() for p in r.passages or [])
    assert substring_dedup.passage_classes(frame.limit(0)).count() == 0


def test_a_run_that_many_units_hold_gives_its_pairs_once():
    rng = np.random.default_rng(8)
    zone, n = substring_dedup.ZONE, 400
    text = rng.integers(1, 1 << 32, n + 2 * zone, dtype=np.uint64)
    h = rng.permutation(n)
    units = [(lo, c, hi) for lo, c, hi in substring_dedup.compact_windows(h) if zone <= c < n - zone]
    around = lambda c: text[c - zone : c + zone + 1].astype("<u4")[None]
    kept = [c for lo, c, hi in units if not substring_dedup.deferred(around(c), around(c), np.array([c - lo]), np.array([hi - c]))[0]]
    # the least one of every run as long as what can be seen stays
    assert all(any(abs(c - k) <= zone for k in kept) for _, c, _ in units) and len(kept) < len(units) / 4


def test_forest_looks_rows_up_by_their_probes():
    rng = np.random.default_rng(5)
    zone = substring_dedup.ZONE
    rows = rng.integers(1, 1 << 32, (3000, 2 * zone + 1), dtype=np.uint64).astype("<u4")
    rows[:, zone - 3 : zone + 4] = 7
    rows[1000:1020] = rows[5]
    rows[1000:1020, zone + 70] += np.arange(20, dtype=np.uint32)
    assert {j for i, j in substring_dedup.forest(rows)} == set(range(1000, 1020))
    assert substring_dedup.forest(rows[:0]) == [] == substring_dedup.forest(rows[:1])


def test_blocks_of_a_unit_give_their_pairs_once():
    rng = np.random.default_rng(6)
    zone, blocks = substring_dedup.ZONE, 5
    rows = rng.integers(1, 1 << 32, (300, 2 * zone + 1), dtype=np.uint64).astype("<u4")
    rows[:] = rows[rng.integers(0, 20, 300)]
    rows[:, zone + 80] += np.arange(300, dtype=np.uint32)
    block = rng.integers(0, blocks, 300)

    def rooted(pairs):
        top = np.arange(300)
        for _ in range(300):
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top.tolist()

    found = []
    for low in range(blocks):
        for high in range(low + 1, blocks):
            held = np.flatnonzero((block == low) | (block == high))
            found += [(held[i], held[j]) for i, j in substring_dedup.between(rows[held], block[held], blocks)]
    assert rooted(found) == rooted(substring_dedup.forest(rows))
    # a group in a block has one pair less than rows there, and one for each pair of blocks
    assert len(found) <= 300 + 20 * blocks * (blocks - 1) / 2


def test_repetitive_texts_cost_no_more_than_others():
    for text in ("tick " * 80_000, "tick tock " * 40_000):
        data = np.frombuffer(text.encode(), np.uint8)
        values, bounds = substring_dedup.shingles(data, np.array([0, len(data)]))
        h = substring_dedup.N.mixed(values)
        assert len(substring_dedup.compact_windows(h)) <= len(h)


def test_ego_join_finds_each_pair_once_and_skips_distant_leaves():
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(300, 64)))
    x = unit(np.concatenate([centres, centres[:200] + rng.normal(size=(200, 64)) * 0.04, np.repeat(centres[:1], 150, 0) + rng.normal(size=(150, 64)) * 0.02]))
    y = unit(np.concatenate([rng.normal(size=(90, 64)), centres[:50] + rng.normal(size=(50, 64)) * 0.05]))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i < j}
    got = [p for i, j in embed_dedup.ego_pairs(x, x, x, x, 0.9, True) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    got = [p for i, j in embed_dedup.ego_pairs(x, y, x, y, 0.9, False) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ y.T >= 0.9))))
    shares = []
    for n in (4_000, 16_000):
        z, compared = unit(rng.normal(size=(n, 64))), []
        list(embed_dedup.ego_pairs(z, z, z, z, 0.9, True, compared))
        shares.append(sum(compared) / len(embed_dedup.dimension_groups(64)) / (n * n / 2))
    assert shares[1] < shares[0] < 1


def test_warc_of_large_payloads_and_of_no_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (1000, 100_000))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    rng = random.Random(5)
    pages = {i: "".join(rng.choices("abcdefgh <>", k=n)) for i, n in enumerate([3, 10, 900, 50_000, 60_000, 70_000, 80_000, 300_000, 3_000_000, 0])}
    frame = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in pages.items()], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.deduplicated(frame), str(tmp_path / "w"))
    sizes = [sum(len(b) for _, b in warc.parse_archive(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert sum(s > 250_000 for s in sizes) == 2 and len(sizes) >= 5
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_captures(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for i, t in pages.items()}
    frame.limit(0).write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    assert queries.op9_warc(spark, str(tmp_path / "sf")).count() == 0


def test_shifted_passages_equal_a_plain_search():
    """Passages with inserted or deleted words, repeats among them, against sets of shingles tried place by place."""
    import random

    from tidewire.llm import substring_dedup as D

    def plainly(a, b, at, bt):
        lo, lo_b = max(0, at - D.LEAST + 1), max(0, bt - D.LEAST - D.SLIP + 1)
        near = set(b[lo_b : bt + D.LEAST + D.SLIP])
        held = [sum(v in near for v in a[s : s + D.LEAST]) for s in range(lo, min(at, len(a) - D.LEAST) + 1)]
        if not held or max(held) < D.LEAST * 2 * D.SIMILARITY / (1 + D.SIMILARITY) - D.SLIP:
            return None
        s, best = lo + held.index(max(held)), None
        x = set(a[s : s + D.LEAST])
        for wide in range(-D.SLIP, D.SLIP + 1):
            for t in range(s + bt - at - D.SLIP, s + bt - at + D.SLIP + 1):
                if t >= 0 and t + D.LEAST + wide <= len(b):
                    y = set(b[t : t + D.LEAST + wide])
                    alike = len(x & y) / len(x | y)
                    if alike >= D.SIMILARITY and (best is None or alike > best[3]):
                        best = (s, s + D.LEAST, t - s, alike)
        return best

    r, found = random.Random(4), 0
    for _ in range(1500):
        kinds = r.choice([3, 30, 10**6])
        a = [r.randrange(kinds) for _ in range(r.randint(40, 160))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            p = r.randrange(len(b))
            b[p : p + r.randint(0, 2)] = [r.randrange(kinds) for _ in range(r.randint(0, 2))]
        at = r.randrange(len(a))
        bt = min(len(b) - 1, max(0, at + r.randint(-4, 4)))
        got, want = D.shifted_passage(np.array(a, np.uint64), np.array(b, np.uint64), at, bt), plainly(a, b, at, bt)
        assert got == want
        found += want is not None
    assert found > 500
