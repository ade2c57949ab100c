"""The corpus pipeline against the plain versions of its stages, run one after the other on its whole input."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("tidewire.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_text_operators import brute_components, brute_lines, brute_simhash, brute_tokens, plain_distance  # noqa: E402

from tidewire.llm import bpe, decontaminate, quality  # noqa: E402

SENTENCES = [f"sentence {a} tells of {b} and of {a} again in plain words" for a in ("rivers", "mills", "birds", "trains") for b in ("winter", "trade", "music", "bread")]
ITEM = "the seventh lantern keeper counted forty silver herons above the frozen canal"


def corpus():
    """Good texts (sentences) and bad ones (marks), with exact and near copies, repeated lines and a benchmark leak."""
    rng = np.random.default_rng(4)
    good = lambda k: "\n".join(f"{SENTENCES[i]} {k}x{i}y{k * 7 + i} w{rng.integers(9999)} w{rng.integers(9999)}" for i in rng.permutation(16)[:5])
    bad = lambda k: " ".join(f"$$ #{rng.integers(99)} @@@ !!" for _ in range(12 + k % 5))
    rows = [(k, good(k) if k % 2 else bad(k)) for k in range(60)]
    rows += [(100, rows[1][1]), (101, rows[3][1] + "\nand a closing line that is quite new here"), (102, good(102) + "\n" + ITEM.upper()), (103, good(103) + "\nas we heard " + ITEM.replace("silver", "silvr") + " that day"), (108, rows[5][1].replace("\n", " ")), (104, None), (105, ""), (106, "short good line of words"), (107, good(107) * 3)]
    return rows


def plain_pipeline(rows, labels):
    """(the doc_ids kept by each stage, the final rows by id)."""
    size, stages = 1 << quality.FEATURE_BITS, []
    texts = dict(rows)

    def shares(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        counts = {}
        for number, _ in quality.features(data, np.array([0, len(data)])):
            for at in number.tolist():
                counts[at] = counts.get(at, 0) + 1
        total = max(1, sum(counts.values()))
        return {at: n / total * quality.SCALE for at, n in counts.items()}

    taught = sorted((k, y) for k, y in labels.items() if k in texts and zlib.crc32(str(k).encode()) % 3 != 1)
    seen = [(shares(texts[k]) | {size: 1.0}, y) for k, y in taught]
    z, n, w_of = {}, {}, lambda at: 0.0 if abs(z.get(at, 0)) <= 0.02 else -(z[at] - np.sign(z[at]) * 0.02) / ((1 + n[at] ** 0.5) / 0.3 + 0.1)
    rng = np.random.default_rng(7)
    for _ in range(4):
        for r in rng.permutation(len(seen)):
            x, y = seen[r]
            p = 1 / (1 + np.exp(-sum(w_of(at) * v for at, v in x.items())))
            for at, w in {at: w_of(at) for at in x}.items():
                g = (p - y) * x[at]
                z[at] = z.get(at, 0.0) + g - ((n.get(at, 0.0) + g * g) ** 0.5 - n.get(at, 0.0) ** 0.5) / 0.3 * w
                n[at] = n.get(at, 0.0) + g * g
    rows = [(k, t) for k, t in rows if sum(w_of(at) * v for at, v in shares(t).items()) + w_of(size) >= 0]
    stages.append({k for k, _ in rows})
    cut = brute_lines(rows)
    rows = [(k, c) for (k, t), c in zip(rows, cut) if not (t or "").strip() or any(x.strip() for x in (c or "").split("\n"))]
    stages.append({k for k, _ in rows})
    first = brute_components([k for k, _ in rows], [brute_simhash(t) for _, t in rows])
    rows = [(k, t) for (k, t), c in zip(rows, first) if k == c]
    stages.append({k for k, _ in rows})
    item = decontaminate.normalised(ITEM)
    rows = [(k, t) for k, t in rows if plain_distance(item, decontaminate.normalised(t)) > decontaminate.budget(len(item))]
    stages.append({k for k, _ in rows})
    encoding, out = bpe._encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN), {}
    for k, t in rows:
        ids = brute_tokens(encoding, t or "")
        out[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return stages, out


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows, labels = corpus(), {k: int(k % 2) for k in range(50)}
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, want = plain_pipeline(rows, labels)
    # every stage has something to do, and clean documents pass
    before = {k for k, _ in rows}
    for kept in stages:
        assert kept < before, "a stage of the fixture removes nothing"
        before = kept
    assert {k for k, t in rows if k % 2 and k < 60} <= stages[0] and not {102, 103} & set(want) and len(want) > 25
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name


def test_results_of_other_queries_survive_a_pipeline(spark, small):
    from tidewire.llm import queries

    lines = queries.op4_line_dedup(spark, small)
    before = lines.count()
    corpus_pipeline.run(spark, small).count()
    assert lines.count() == before and lines.select("text_sha256").distinct().count() > 1
