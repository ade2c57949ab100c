"""Lookup of many terms in one pass over each text: an Aho-Corasick automaton that an Arrow batch shares.

``F.contains`` per term reads a text once per term; here the time a text takes doesn't grow with the number of terms, so
labels, events and sections are derived from one set of hits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Collection, Iterable
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("sentences", T.ArrayType(T.ArrayType(T.StringType())))])
_ARROW_HITS = pa.struct([("terms", pa.list_(pa.string())), ("sentences", pa.list_(pa.list_(pa.string())))])
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_SPACES = ["", " ", "\t", "\n", "\v", "\f", "\r"]
_CLASSES = {r"\d": list("0123456789"), r"\s?": _SPACES, r"[-\s]?": ["-", *_SPACES]}


def spelled_out(pattern: str) -> list[str]:
    """The terms that a pattern of alternatives stands for, which uses no classes but ``\\d``, ``\\s?`` and ``[-\\s]?``."""
    out = []
    for part in pattern.split("|"):
        pieces = re.split(r"(\[-\\s\]\?|\\s\?|\\d)", part)
        if any(re.search(r"[\\\[\](){}?*+.^$]", p) for p in pieces if p not in _CLASSES):
            raise ValueError(f"not a list of terms: {part}")
        out += map("".join, product(*[_CLASSES.get(p, [p]) for p in pieces]))
    return out


@lru_cache(maxsize=32)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def _find(text: str, automaton, words: frozenset[str], mark: re.Pattern | None, paired: frozenset[str]) -> dict:
    """The terms of one text, and the ``paired`` ones of each sentence that holds any."""
    found, by_sentence, ends = set(), {}, None
    for last, term in automaton.iter(text):
        if term in words:
            first = last - len(term)
            if (first >= 0 and text[first] in _WORD) or text[last + 1 : last + 2] in _WORD:
                continue
        found.add(term)
        if term in paired:
            if ends is None:
                ends = [m.start() for m in mark.finditer(text)]
            by_sentence.setdefault(bisect_right(ends, last), set()).add(term)
    return {"terms": sorted(found), "sentences": [sorted(s) for _, s in sorted(by_sentence.items())]}


def hits(text: Column, terms: Iterable[str], words: Collection[str] = (), marks: str | None = None, paired: Iterable[str] = ()) -> Column:
    """struct(terms, sentences): which of the terms a text holds, distinct and in order, overlapping ones too.

    ``words`` count only between characters other than a-z and 0-9. ``sentences`` lists the ``paired`` ones of the terms
    for each stretch between ``marks`` (a pattern) that holds any; a term with a mark inside is in none. A null text
    gives null.
    """
    known = tuple(sorted(set(terms)))
    if "" in known:
        raise ValueError("an empty term is in every text")
    bounded, mark = frozenset(words) & frozenset(known), re.compile(marks) if marks else None
    asked = frozenset(t for t in paired if t in known and mark is not None and not mark.search(t))

    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        automaton = _automaton(known)
        one = lambda t: None if t is None else _find(t, automaton, bounded, mark, asked) if known else {"terms": [], "sentences": []}
        return pa.array(map(one, texts.to_pylist()), _ARROW_HITS)

    return find(text)


def some_of(found: Column, terms: Iterable[str]) -> Column:
    """Whether an array of hits holds one of the terms."""
    terms = list(terms)
    return F.arrays_overlap(found, F.array(*map(F.lit, terms))) if terms else F.lit(False)


def together(sentences: Column, *groups: Iterable[str]) -> Column:
    """Whether one sentence holds a term of each group."""

    def inside(sentence: Column) -> Column:
        out = F.lit(True)
        for g in groups:
            out = out & some_of(sentence, g)
        return out

    return F.exists(sentences, inside)
