"""Hard negatives, pattern packing and source divergence against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidewire.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidewire.llm import divergence, hard_negatives, pattern_pack, queries  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, score string, block string, pivot string"


def mined(rows, positives=5, negatives=10):
    """The contract by plain loops; rows: {vec_id: (label, integer vector)}."""
    out = []
    width = max((len(v) for _, v in rows.values()), default=0)
    ids = np.array(sorted(rows))
    labels = np.array([rows[i][0] for i in ids])
    matrix = np.array([list(rows[i][1]) + [0] * (width - len(rows[i][1])) for i in ids], np.int64).reshape(len(ids), width)
    for a in ids[ids % 100 == 0] if len(ids) else []:
        at = int(np.flatnonzero(ids == a)[0])
        score = matrix @ matrix[at]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != a]
        for p in [i for i in order if labels[i] == labels[at]][:positives]:
            fits = [i for i in order if labels[i] != labels[at] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives]
            out += [(int(a), int(ids[p]), n + 1, int(ids[i]), int(score[p]), int(score[i])) for n, i in enumerate(fits)]
    return sorted(out)


def integers(rows):
    """What takes part of (vec_id, embedding, label): valid rows, the smallest of each key."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        new = (label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        held[i] = min(held.get(i, new), new)
    return held


def mine(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(hard_negatives.integer_rows(frame), F.col("vec_id") % 100 == 0)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread):
    for name, n in (("SAMPLE", 200), ("ROWS", 64), ("QUERIES", 16), ("PIVOTS", 8)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(x) for x in centres[i % 12] + spread * rng.normal(size=16)], int(rng.integers(0, 4))) for i in range(3000)]
    rows += [(i, rows[0][1], 1) for i in range(3000, 3400)]  # one vector that many rows share
    assert mine(spark, rows) == mined(integers(rows))


def test_hard_negatives_odd_rows(spark):
    assert mine(spark, []) == []
    rng = random.Random(3)
    plain = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(60)]
    odd = [(None, [1.0] * 4, 1), (100, [0.5] * 4, 0), (100, [0.25] * 4, 0), (100, [0.5] * 4, 0), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0], 1), (300, [0.4] * 4, None), (400, [], 1), (401, [0.3], 0), (402, [0.3, 0.2, 0.1, 0.1, 0.9], 1), (-100, [0.5, 0.1, 0.1, 0.1], 2), (500, [0.0] * 4, 0)]
    assert mine(spark, plain + odd) == mined(integers(plain + odd))
    with pytest.raises(ArithmeticError):
        mine(spark, [(0, [3e7] * 4, 1), (1, [1.0] * 4, 1)])


def test_hard_negative_query_equals_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, small).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == mined(integers(rows))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packed_pieces_hold_every_token_once(spark):
    file, pattern, library = tokenizer()
    rng = random.Random(4)
    words = ["alpha", "Straße", "don't", "42", "\n\n", "  ", "日本語", "<|endoftext|>", "é", "\t", "🙂", "it's", " "]
    texts = [None, "", " ", "one", "x" * 9000, *(" ".join(rng.choices(words, k=rng.choice([3, 50, 300, 2500]))) for _ in range(80))]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(7, texts[7], "a", "b", "c"), (None, "no key", "a", "b", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id string, offset string")
    placed = pattern_pack.place(pattern_pack.token_pieces(frame, file, pattern, 2, 256), 256)
    got = placed.collect()
    held = collections.defaultdict(list)
    for r in got:
        held[r.doc_id].append(r)
    for key in set(held):
        texts_of = [t for i, t, *_ in rows if i == key]
        want = library.encode(texts_of[0] or "", add_special_tokens=False).ids + [2]
        pieces = sorted(held[key], key=lambda r: r.piece)
        assert len(pieces) == len(texts_of) * -(-len(want) // 256)
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == want[r.start : r.start + r.length] and (r.length == 256 or r.piece == 0)
    assert set(held) == {i for i, *_ in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 256
    bound = -(-sum(r.length for r in got) // 256)
    assert bound <= len(by) <= bound + max(2, bound // 50)
    whole = {r.sequence_id: r for r in pattern_pack.sequences(placed).collect()}
    assert set(whole) == set(by) and all(len(r.ids) == 4 * r.n_tokens == 4 * sum(n for _, n in by[k]) for k, r in whole.items())
    assert pattern_pack.place(pattern_pack.token_pieces(frame.limit(0), file, pattern, 2)).count() == 0


def test_words_of_every_character_get_the_librarys_ids():
    file, pattern, library = tokenizer()
    assert pattern == pattern_pack.PRE_SPLIT
    with open(file, encoding="utf-8") as f:
        encode = pattern_pack.WordEncoder(f.read(), pattern)
    texts = [f"a{c}b {c}{c}{c}x{c} 'll{c}1{c}\n{c}" for c in map(chr, [*range(0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x20000, 41)])]
    whole = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, whole) if np.frombuffer(encode.text(t), "<u4").tolist() != w.ids]
    assert not wrong, wrong[:5]


def test_plans_use_every_piece_and_beat_plain_best_fit():
    rng = np.random.default_rng(6)
    shapes = [np.bincount(rng.integers(1, 1025, 5000), minlength=1025), np.bincount(rng.integers(340, 520, 5000), minlength=1025), np.bincount(np.minimum(1024, 1 + rng.exponential(250, 50000).astype(int)), minlength=1025), np.bincount([1] * 3000, minlength=1025), np.zeros(1025, int)]
    for counts in shapes:
        planned = pattern_pack.plan(counts, 1024)
        used = np.zeros(1025, int)
        for lengths, n in planned:
            assert sum(lengths) <= 1024
            np.add.at(used, lengths, n)
        assert (used == counts).all()
        total = sum(n for _, n in planned)
        assert total <= sum(n for _, n in pattern_pack.best_fit(counts, 1024)) and total >= -(-(counts @ np.arange(1025)) // 1024)
        runs = pattern_pack.runs_of(planned)
        assert len(runs) < 300_000 and len({(a, b) for a, b, *_ in runs.tolist()}) == len(runs)


def test_sequences_beyond_the_length_classes(spark):
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, rng.choice([5000, rng.randint(1, 5000)])) for i in range(500)], "id long, length long")
    by = collections.defaultdict(list)
    for r in pattern_pack.place(frame, 5000).collect():
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 5000
    assert sum(map(len, by.values())) == 500


def test_packing_query_reports_the_ids_of_its_pieces(spark, small):
    file, _, library = tokenizer()
    got = queries.op12_pattern_packing(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got[::7]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    tokens, used = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert used <= -(-tokens // 1024) * 1.05


def audited(rows, least, smooth=5, top=50):
    """The contract by plain loops; rows: (text, lang, source)."""
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        for t in terms:
            counts[lang, source, t] += 1
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        scale = lambda n, total: 1 + 1_000_000_000 * (n + smooth) // (total + smooth * len(kept))
        totals = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        q = {t: scale(sum(counts[lang, s, t] for s in sources), sum(totals.values())) for t in kept}
        p = {s: {t: scale(counts[lang, s, t], totals[s]) for t in kept} for s in sources}
        for s in sources:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s], "term": [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]}
            for part, values in parts.items():
                for rank, (value, item) in enumerate(sorted(values)):
                    if part == "pair" or rank < top:
                        out.add((lang, s, part, item.decode(), -value, rank + 1))
    return out


def rows_of(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("terms,groups", [(256, 256), (3, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, terms, groups):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    rng = random.Random(9)
    words = [*"abcdefgh", "Über", "über", "İx", "日本", "don't", "A1b", "_x_", "é", "🙂"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice([None, "", "s1", "s2", "s3", "s4", "s5", "é"])) for _ in range(300)]
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("a " * 50_000, "en", "s2"), ("rare", "fr", "x"), ("rare", "fr", "y"), ("rare", "it", "alone"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, n int, item string")
    got = rows_of(divergence.divergences(frame, least_docs=12))
    want = audited(rows, 12)
    assert set(got) == want and len(got) == len(want)
    assert {v for g, _, part, _, v, _ in got if g == "fr"} == {0}
    assert rows_of(divergence.divergences(frame.limit(0))) == []


def test_scaled_frequencies_are_exact_for_large_counts():
    rng = random.Random(10)
    for _ in range(200):
        total = rng.randint(1, 8 * 10**15)
        count = rng.randint(0, total)
        assert divergence.scaled(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def test_divergence_query_equals_brute_force(spark, small):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = rows_of(queries.op13_source_divergence(spark, small))
    assert set(got) == audited(rows, 30) and len(got) == len(set(got))
