"""Quality, decontamination, line dedup, BPE and SimHash against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash

pytest.importorskip("tidewire.llm")
from tidewire.llm import bpe, decontaminate, line_dedup, quality, queries, simhash  # noqa: E402
from tidewire.llm.components import components  # noqa: E402

WEIRD = [
    (1, "one two three four five six\n\n  one  two three four FIVE six \nshort line", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "one two three four five six", "de"),
    (4, "one two three four five six", "de"),
    (5, " \t\n ", "en"),
    (6, "one two three four nine six\n\tone two three four five six seven\nshort lime", "en"),
    (7, "x" * 300_000 + " " + "y z " * 1000, "en"),
    (None, "two one three four five six\nalone in the world it stands\r\nalone in the world it stood", "en"),
]


@pytest.fixture(scope="module")
def weird(spark):
    # extra columns with the names the operators use inside
    return spark.createDataFrame([(*r, 5, 6, 7) for r in WEIRD], "doc_id long, text string, lang string, line long, key long, fp long")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_components_of_chains_stars_and_copies(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 501), (501, 500), (7, 7), (900, 900)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 140)), [500, 501]]
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, fps, k=3):
    parent = {f: f for f in set(fps)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= k:
            parent[top(a)] = top(b)
    least = {}
    for key, f in zip(keys, fps):
        if key is not None:
            least[top(f)] = min(key, least.get(top(f), key))
    return [least.get(top(f)) for f in fps]


def test_simhash_query_equals_brute_force(spark, small, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, small).collect()}
    keys = list(docs)
    fps = [brute_simhash(docs[k]) for k in keys]
    assert got == {k: (f"{f:016x}", c) for k, f, c in zip(keys, fps, brute_components(keys, fps))}


def test_simhash_odd_rows(spark, weird):
    rows = simhash.near_duplicates(weird).collect()
    fps = [brute_simhash(t) for _, t, _ in WEIRD]
    want = [(k, f"{f:016x}", c) for (k, _, _), f, c in zip(WEIRD, fps, brute_components([k for k, _, _ in WEIRD], fps))]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert simhash.near_duplicates(weird.limit(0)).count() == 0


def test_index_finds_all_pairs_in_crowded_groups(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    x = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 300), dtype=np.uint64), axis=0) for c in centre] + [rng.integers(0, 2**63, 300, dtype=np.uint64)])
    x = np.unique(x)
    x = x[np.argsort(simhash.gray_rank(x), kind="stable")]
    i, j = simhash.close_pairs(x, 3)
    want = {(a, b) for a, b in combinations(range(len(x)), 2) if int(x[a] ^ x[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want
    # tiles of a few fingerprints: the same components
    table = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for tile, blocks in ((16, 4), (1024, 5)):
        got = {r.node: r.root for r in components(simhash.fingerprint_links(table, 3, blocks, tile)).collect()}
        rooted = brute_components(list(range(len(x))), [int(v) for v in x])
        groups = {}
        for v, c in zip(x.view(np.int64).tolist(), rooted):
            groups.setdefault(c, set()).add(got.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**15)] == [4, 4, 4, 5, 6, 6]


def brute_tokens(encoding, text):
    import regex

    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in encoding.encode_ordinary(m)]


def test_bpe_query_round_trip(spark, small, docs):
    encoding = bpe._encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    for r in queries.op7_bpe(spark, small).collect():
        text = docs[r.doc_id] or ""
        ids = brute_tokens(encoding, text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_long_and_odd_texts(spark, weird):
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode_decode(weird, rank_file, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t, _ in WEIRD)
    encoding = bpe._encoding(open(rank_file, "rb").read(), public_tokenizers.PATTERN)
    for text in ("don't  stop\n\n now 12 a1!? " * 40, "   lead", "a b", " \t x  y   z ", "<|endoftext|> ok", "日本 語 é"):
        for size in (1, 3, 10):
            assert bpe.encode_text(encoding, text, size).tolist() == encoding.encode_ordinary(text)
            assert "".join(bpe.safe_pieces(text, size)) == text
    assert bpe.encode_decode(weird.limit(0), rank_file, public_tokenizers.PATTERN).count() == 0


def plain_distance(item, text):
    """Least edit distance of the item to any part of the text, by the textbook recurrence."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, d in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != d))
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 14)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    rows = []
    for k in range(60):
        text = " ".join(word() for _ in range(30))
        if k % 2:
            planted = list(items[k % 12][1])
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(planted))
                planted[p : p + 1] = rng.choice([[], ["q"], [planted[p], "q"]])
            text = text[: k * 2] + "".join(planted).upper() + "\n" + text[k * 2 :]
        rows.append((k, text))
    rows += [(90, None), (91, ""), (None, items[0][1] + "  "), (92, items[1][1].replace(" ", " \n ")), (92, items[1][1])]
    want = []
    for k, t in rows:
        for i, item in items:
            if item and len(item.split()) >= 5:
                d = plain_distance(decontaminate.normalised(item), decontaminate.normalised(t))
                if d <= decontaminate.budget(len(decontaminate.normalised(item))):
                    want.append((k, i, d))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def brute_lines(rows):
    """Per row the lines that stay."""

    def words(line):
        return tuple(re.split(r"[ \t\x0b\f\r]+", line.lower().strip(" \t\x0b\f\r")))

    def near(a, b):
        if a == b:
            return True
        if max(len(a), len(b)) < 5 or min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    placed = sorted({(k is not None, k or 0, n, words(x)) for k, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\f\r")})
    going = {p for i, p in enumerate(placed) if any(near(p[3], q[3]) and q[:3] < p[:3] for q in placed[:i])}
    # of one key's rows with different lines at one place, equal verdicts are by the line itself
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" \t\x0b\f\r") or (k is not None, k or 0, n, words(x)) not in going) if t is not None else None for k, t in rows]


def test_line_dedup_equals_brute_force(spark, small, docs, weird):
    rows = [(k, t) for k, t, _ in WEIRD]
    got = line_dedup.dedup_lines(weird)
    assert [c for c in weird.columns if c != "text"] + ["text", "n_lines", "n_kept"] == got.columns
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got.collect()) == sorted((repr(k), repr(t)) for (k, _), t in zip(rows, brute_lines(rows)))
    assert line_dedup.dedup_lines(weird.limit(0)).count() == 0
    want = dict(zip(docs, brute_lines(list(docs.items()))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == want


def test_line_dedup_random_edits(spark):
    rng = random.Random(8)
    lines = []
    for _ in range(40):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(4, 9))]
        for _ in range(4):
            v = list(w)
            p = rng.randrange(len(v))
            v[p : p + 1] = rng.choice([[], ["zz"], [v[p], "zz"], [v[p]], [v[p], v[p]]])
            lines.append(" ".join(v))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 8 : i * 8 + 8])) for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([k for k, _ in rows], brute_lines(rows)))


def test_quality_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(labels[k], got[k].score) for k in labels if got[k].held_out]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95, auc


def test_quality_odd_rows(spark, weird):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, text int")
    rows = quality.classify(weird, labels).collect()
    assert len(rows) == len(WEIRD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(weird, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(weird.limit(0), labels).count() == 0
    assert quality.accepted(weird, labels).columns == weird.columns


def test_decontamination_searches_short_and_unspaced_items(spark):
    unspaced = "机器学习模型的训练数据必须去除所有基准测试的内容以免泄漏结果"
    edited = unspaced.replace("必须", "必需")
    items = [(1, unspaced), (2, "Paris"), (3, "深度学习"), (4, "internationalisation considerations"), (5, " "), (6, None)]
    docs = [(1, f"前言{edited}后记"), (2, "in  PARIS, today"), (3, "comparison of parishes"), (4, "我们用深度学习方法"), (5, "an internationalisation consideration s"), (6, "paris"), (7, "nothing"), (8, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1), (2, 2, 0), (4, 3, 0), (5, 4, 1), (6, 2, 0)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 7, 8}


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a b c d e f\nshort", "x"), (2, "a b c d e g\nshort\nnew words stand here now", "y"), (None, "short", "z")]
    frame = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string, _kept string, _key long, _hash long, k long, h long, n_lines long, `a.b` long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert (got[1].text, got[2].text, got[None].text) == ("a b c d e f", "new words stand here now", "short")
    assert (got[2].n_lines, got[2].n_kept, got[2]._kept, got[2]["a.b"]) == (3, 1, "y", 5)


def test_decontamination_keys_of_any_type_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    words = "amber birch cedar delta ember flint grove heron ivory jewel".split()
    items = [(f"item-{i}", " ".join(words[i:] + words[:i])) for i in range(6)] + [(None, " ".join(reversed(words)))]
    docs = [(f"d{i}", f"so {t} it is") for i, (_, t) in enumerate(items)] + [(None, None), ("clean", "nothing of the sort stands in here")]
    docs, bench = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect() if r.distance == 0}
    assert got == {(f"d{i}", k) for i, (k, _) in enumerate(items)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {None, "clean"}


def test_first_of_each_group_of_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (3, text + " more", "c"), (None, "alone and unlike the others", "d"), (9, None, "e"), (8, " ", "f"), (None, "", "g"), (7, "one of its kind", "h")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, k long, first long")
    got = simhash.first_of_each(frame)
    assert got.columns == frame.columns
    assert sorted(r.lang for r in got.collect()) in (["b", "d", "g", "h"], ["c", "d", "g", "h"])
    assert simhash.first_of_each(frame.limit(0)).count() == 0


def plain_features(text):
    """The hashed n-grams of a text by plain arithmetic: per sort of n-gram their numbers in order."""
    m = 2**64

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ x >> 27) * 0x94D049BB133111EB % m
        return x ^ x >> 31

    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())
    spelled, shaped = [], []
    for run in runs:
        low = re.sub(rb"[A-Z]", lambda c: c[0].lower(), run)
        spelled.append(mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, m) for i, b in enumerate(low)) % m))
        upper = len(re.findall(rb"[A-Z]", run))
        style = 0 if not upper else 2 if upper == len(run) else 1 if run[:1].isupper() else 3
        kind = 1 if re.match(rb"[0-9A-Za-z\x80-\xff]", run) else 2
        shaped.append(mixed((kind * 4 + style) * 16 + min(len(run), 15) + 1))
    out = []
    for salt, (hashes, n) in enumerate(((spelled, 1), (spelled, 2), (shaped, 1), (shaped, 3)), 1):
        salted, numbers = [h ^ salt * 0x2545F4914F6CDD1D % m for h in hashes], []
        for i in range(len(salted) - n + 1):
            x = salted[i]
            for h in salted[i + 1 : i + n]:
                x = (x * 0xD6E8FEB86659FD93 + h) % m
            numbers.append(mixed(x) >> 64 - quality.FEATURE_BITS)
        out.append(numbers)
    return out


def test_quality_features_equal_plain_version():
    texts = ["Hello, WORLD! 42 naïve iPhones...", "", " \t", "one", "a b", "Łódź — x²  (ok)"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(texts):
        assert [number[bounds[i] : bounds[i + 1]].tolist() for number, bounds in got] == plain_features(text)


def test_lines_are_split_into_words_once(spark, monkeypatch):
    """The words of lines that may have a near one are fetched by the place of their first rows."""
    from tidewire.llm import line_dedup

    asked = []
    plain = line_dedup.may_match
    monkeypatch.setattr(line_dedup, "may_match", lambda rows, *a: asked.append((rows.columns, rows.count(), (got := plain(rows, *a)).count())) or got)
    text = "one two three four five six\none two three four five\nquite another line of six words\nshort"
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[0] == "one two three four five six\nquite another line of six words\nshort" and set(kept[i] for i in range(1, 20)) == {""}
    # Of 80 lines only the first rows of the two alike pass.
    assert asked == [(["place", "raw"], 80, 2)]
