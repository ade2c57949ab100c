"""Benchmark decontamination by pigeonhole edit matching with Myers verification.

An item of n characters may be changed by ``budget(n)`` edits. Cut into budget + 1 pieces, at least one piece survives
unchanged wherever the item occurs within its budget. All pieces are searched in one Aho-Corasick pass over a text, and
each hit's surroundings are verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import byte_slices

#: Allowed edits, as a share of an item's characters.
EDIT_RATE = 0.08
#: Items of fewer words and fewer characters than these match only exactly and as whole words.
MIN_WORDS, MIN_CHARS = 5, 20
#: Bytes of benchmark text that one pass over the documents carries; larger benchmarks take several passes.
BLOCK_BYTES = 4 << 20


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = EDIT_RATE) -> int:
    return int(n * rate)


def pieces(item: str, rate: float = EDIT_RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 nearly equal pieces of an item."""
    parts = budget(len(item), rate) + 1
    edge = [round(p * len(item) / parts) for p in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:]) if b > a]


def matched_exactly(item: str) -> bool:
    return len(item) < MIN_CHARS and len(item.split()) < MIN_WORDS


#: Scripts that don't part words by spaces: South-East Asian, kana and Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def parted(a: str, b: str) -> bool:
    """Whether a word may end between two characters; '' is the text's end. Unspaced scripts allow it everywhere."""
    return not (a.isalnum() and b.isalnum()) or any(lo <= ord(c) <= hi for c in (a, b) for lo, hi in UNSPACED)


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, window: str, most: int) -> tuple[int, int]:
    """(distance, end) of the best match of the m-character pattern anywhere in ``window``; distance most + 1 if none."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for at, c in enumerate(window):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """All items of one benchmark block: the piece automaton and the items' bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.rate, self.items, found = rate, {}, defaultdict(list)
        for number, (key, text) in enumerate(items):
            self.items[number] = (key, text, masks(text))
            for offset, piece in pieces(text, 0 if matched_exactly(text) else rate):
                found[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Item number -> least distance, for all items within their budget somewhere in the normalised text."""
        windows: dict[int, set[int]] = defaultdict(set)
        if not len(self.automaton):
            return {}
        for end, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                windows[number].add(end + 1 - size - offset)
        out = {}
        for number, begins in windows.items():
            _, item, peq = self.items[number]
            if matched_exactly(item):
                ends = ((b, b + len(item)) for b in begins)
                if any(parted(text[max(0, b - 1) : b], item[0]) and parted(item[-1], text[e : e + 1]) for b, e in ends):
                    out[number] = 0
                continue
            most, covered = budget(len(item), self.rate), -1
            for begin in sorted(begins):
                lo, hi = max(0, begin - most), begin + len(item) + most
                if hi <= covered:
                    continue
                # From the first hit on, neighbours within the budget share one window.
                covered = hi + most
                distance, _ = myers(peq, len(item), text[lo:covered], most)
                if distance <= most:
                    out[number] = min(distance, out.get(number, distance))
        return out


def _blocks(benchmark: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's searchable items in blocks of bounded size, taken one block at a time."""
    items = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        cleaned = sorted({(r["k"], normalised(r["t"])) for r in rows}, key=lambda x: (x[1], x[0] is not None, str(x[0])))
        yield [x for x in cleaned if x[1]]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """(key, item_id, distance int): every item that occurs in a row's whole text within ``rate`` edits a character.

    Both sides are lower-cased and their white space runs become one space. Items of fewer than ``MIN_WORDS`` words and
    ``MIN_CHARS`` characters must occur unchanged and as whole words. Null and blank items are not searched; null and
    blank texts match nothing; repeated rows repeat their matches; an
    empty benchmark gives an empty result. A row with a null key is searched as well. Items with one key and different
    texts each give a row; keys may be of any type. The benchmark is passed to the executors in blocks of at most about
    ``BLOCK_BYTES``, which follow each other in one scan of the documents; each text is normalised once.
    """
    item_type = benchmark.schema[item_key].dataType
    hit = T.StructType([T.StructField("item", item_type), T.StructField("distance", T.IntegerType())])
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("t", T.StringType()), T.StructField("hits", T.ArrayType(hit))])
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    for number, items in enumerate(_blocks(benchmark, item_key, item_text)):
        out = out.mapInArrow(_searching(docs, items, rate, to_arrow_type(item_type), number == 0), schema)
    return out.select(F.col("k").alias(key), F.explode("hits").alias("hit")).select(key, F.col("hit.item").alias(item_key), "hit.distance")


def _searching(docs: DataFrame, items: list, rate: float, kind: pa.DataType, first: bool):
    """Adds one block's matches to the rows (k, t, hits); the first block normalises the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    hit = pa.struct([("item", kind), ("distance", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            for part in byte_slices(batch, "t"):
                texts = part.column("t").to_pylist()
                texts = list(map(normalised, texts)) if first else texts
                before = [[]] * len(texts) if first else part.column("hits").to_pylist()
                found = [[{"item": matcher.items[n][0], "distance": d} for n, d in matcher.matches(t).items()] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(texts, pa.string()), pa.array([b + f for b, f in zip(before, found)], pa.list_(hit))], ["k", "t", "hits"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, in which no benchmark item occurs; see ``contaminated``."""
    out = docs
    for items in _blocks(benchmark, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                for part in byte_slices(batch, text):
                    yield part.filter(pa.array([not matcher.matches(normalised(t)) for t in part.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
