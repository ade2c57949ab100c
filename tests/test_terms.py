"""One pass of the term automaton against the plain meaning of its results."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import display, terms
from tidewire.operators import events
from tidewire.operators.events import MARKS, NEWS_EVENTS

KNOWN = ["a", "ab", "bab", "b a", "q1", "m&a", "財", "財報", "a.b"]
WORDS = ["q1", "m&a", "ab"]


def plain(text: str, term: str) -> bool:
    bounded = rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"
    return bool(re.search(bounded, text)) if term in WORDS else term in text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abq1m&. \n財報。😀", max_size=40))
def test_one_pass_finds_what_single_searches_find(text):
    paired = [t for t in KNOWN if not re.search(MARKS, t)]
    got = terms._find(text, terms._automaton(tuple(KNOWN)), frozenset(WORDS), re.compile(MARKS), frozenset(paired))
    assert got["terms"] == sorted(t for t in KNOWN if plain(text, t))
    sentences = [sorted(t for t in paired if plain(s, t)) for s in re.split(MARKS, text)]
    assert got["sentences"] == [s for s in sentences if s]


def test_patterns_are_spelled_out():
    pattern = r"gpt[-\s]?\d|kimi\s?k\d|模型"
    known = terms.spelled_out(pattern)
    assert len(known) == 8 * 10 + 7 * 10 + 1
    assert all(re.fullmatch(pattern, t) for t in known) and {"gpt4", "gpt-4", "gpt 4", "kimi k2", "模型"} <= set(known)
    with pytest.raises(ValueError):
        terms.spelled_out("a.*b")


def test_odd_texts(spark):
    """Null gives null; empty and very long texts, an empty list and a list of repeated terms have results."""
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "x" * 3_000_000 + " q1! 財報"), (3, "q12 ab")], "i int, t string")
    got = {r["i"]: r["h"] for r in rows.select("i", terms.hits(F.col("t"), KNOWN + KNOWN, WORDS, MARKS, KNOWN).alias("h")).collect()}
    assert got[0] is None and got[1] == ([], [])
    assert got[2] == (["q1", "財", "財報"], [["q1"], ["財", "財報"]])
    assert got[3] == (["a", "ab"], [["a", "ab"]])
    assert rows.select(terms.hits(F.col("t"), []).alias("h")).where("size(h.terms) > 0").count() == 0
    with pytest.raises(ValueError):
        terms.hits(F.col("t"), ["a", ""])


def test_sections_equal_their_patterns(spark, small):
    text = F.lower(F.concat(F.substring("text", 1, 400), F.lit(" gpt-"), F.col("doc_id") % 20, F.lit(" kimi k"), F.col("doc_id") % 3, F.lit(" 論文")))
    docs = spark.read.parquet(f"{small}/documents.parquet").select(text.alias("c"), F.when(F.col("doc_id") % 5 == 0, "model_release").when(F.col("doc_id") % 5 == 1, "robotics").alias("label"))
    none = F.lit(None).cast("string")
    got = docs.select("c", "label", display.sections(F.col("c"), F.col("label"), none, none).alias("s")).collect()
    for r in got:
        label = r["label"] or ""
        whole = f"{r['c']} {label}"
        models = re.search(display.MODEL_TERMS, r["c"]) or (label == "model_release" and not re.search(display.TOOL_TERMS, whole))
        hits = {"models": models, **{n: re.search(p, whole) or label in display.SECTION_LABELS[n] for n, p in display.SECTION_TERMS.items()}}
        assert r["s"] == ([s for s in display.SECTIONS if hits[s]] or ["industry"])
    assert len(got) == 200 and len({tuple(r["s"]) for r in got}) > 1


def test_events_of_news(spark):
    cases = {
        "Acme reports q3 revenue": ["earnings"],
        "Acme q34": [],
        "合併。公司": [],
        "合併公司": ["market"],
        "SDK guide with eval": [],
        "Hackathon with a data breach": [],
        "财报": ["earnings"],
        "OpenAI launches a new model": ["model_release"],
        "OpenAI launches; a new model": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, title string").coalesce(1)
    got = rows.select("i", events.business_events(F.lit(None).cast("string"), F.col("title"), F.lit(None).cast("string"), NEWS_EVENTS).alias("e")).orderBy("i").collect()
    assert [r["e"] for r in got] == list(cases.values())
