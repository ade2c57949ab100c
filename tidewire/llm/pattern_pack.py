"""Packing of tokenised documents into sequences of one size, by patterns that a non-negative least-squares fit weighs.

1. Every document becomes pieces of at most ``size`` ids; only the first piece may be shorter than ``size``.
2. Spark counts the pieces of each length: a histogram of ``size`` numbers, whatever the number of documents.
3. The driver enumerates all patterns of up to three lengths that fill a sequence exactly, and fits non-negative repeat
   counts to the histogram by least squares (``fit``). Counts are rounded, the strongest pattern first, never beyond
   the pieces there are; what remains is packed best-fit by decreasing length, again on counts alone (``plan``).
4. The pieces of each length are numbered on Spark, and a piece's number names its place in the plan (``place``).

Nothing but the histogram and the plan passes the driver: a plan has at most one run for each position of each pattern
(about 262,000 at a size of 1024, 6 MB), as patterns repeat without getting longer.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_slices, stored

#: A tokenizer file beyond this size is refused instead of broadcast.
MAX_TOKENIZER_BYTES = 64 << 20
#: Encoded words of a generation that a Python worker remembers; it keeps two, so words in use stay.
REMEMBERED = 250_000
#: Length classes of the histogram at most; larger sequences round lengths up to a common step.
CLASSES = 1024
#: Steps of the fit.
STEPS = 400
#: (share of a fitted count, added before rounding down) that ``plan`` tries.
ROUNDINGS = [(share, up) for share in (1, 0.9, 0.75, 0.5) for up in (0, 0.5, 0.999999)]


# Fixed value: the pre-split of byte-level tokenizers.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The same for texts of ASCII and Latin letters alone, where classes are ranges and the standard library is faster.
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile(rf"[^\t\n\x0b\x0c\r -~{_LETTERS}]")


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shows]
    return {b: chr(b) for b in shows} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordEncoder(dict):
    """Ids of words, as bytes: encoded by the ``tokenizers`` library when they are first asked for.

    The library splits a text by ``pattern`` and hands each match to its model by itself, so asking the model match by
    match gives the same ids. That holds for plain byte-level tokenizers; texts of others, and texts that hold the string
    of an added token, go through the library as a whole.
    """

    def __init__(self, tokenizer: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        said = json.loads(tokenizer)
        before = said.get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and said.get("normalizer") is None
        self.tokenizer, self.pattern, self.alphabet = Tokenizer.from_str(tokenizer), regex.compile(pattern), byte_alphabet()
        self.latin = LATIN_SPLIT if pattern == PRE_SPLIT else self.pattern
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            said = word.encode().decode("latin-1").translate(self.alphabet)
            found = self.model.tokenize(said)
            ids = struct.pack(f"<{len(found)}I", *[token.id for token in found])
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.plain or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        split = self.pattern if BEYOND_LATIN.search(text) else self.latin
        return b"".join(map(self.__getitem__, split.findall(text)))


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, pattern: str) -> WordEncoder:
    return WordEncoder(tokenizer, pattern)


def token_pieces(df: DataFrame, tokenizer_file: str, pattern: str, end: int, size: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text and ``end`` after them, cut into pieces of at most ``size`` ids.

    Returns (key, piece int from 0, start long: the document's ids before it, length long, ids binary: little-endian
    unsigned 32-bit integers). All pieces but the first have ``size`` ids. A null text counts as empty and gives the end
    id alone; repeated rows are cut each; a null key stays null; other columns are not read.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(content) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file {tokenizer_file} is larger than {MAX_TOKENIZER_BYTES} characters")
    shared, last = df.sparkSession.sparkContext.broadcast(content), np.uint32(end).astype("<u4").tobytes()
    long = T.LongType()
    out = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern)
        for batch in batches:
            for part in byte_slices(batch, text):
                rows, piece, start, ids = [], [], [], []
                for row, said in enumerate(part.column(text).to_pylist()):
                    got = encode.text(said or "") + last
                    n = len(got) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    rows += [row] * (len(cuts) - 1)
                    piece += range(len(cuts) - 1)
                    start += cuts[:-1]
                    ids += [got[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
                keys = part.column(key).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=out.fieldNames())

    return df.select(key, text).mapInArrow(run, out)


def patterns(there: np.ndarray, size: int) -> np.ndarray:
    """All multisets of one to three of the lengths ``there`` (ascending) with the sum ``size``; unused positions are 0."""
    has = np.zeros(size + 1, bool)
    has[there] = True
    a = np.concatenate([[0], there])
    found = []
    for first in a:  # 0 <= first <= second <= third
        second = a[(a >= first) & (2 * a <= size - first)]
        third = size - first - second
        found.append(np.stack([np.full(len(second), first), second, third], axis=1)[has[third]])
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(made: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns ``made`` that minimise |A x - counts|^2, A counting a pattern's lengths.

    Accelerated projected gradient with restarts; A is never built, as a product with it sums over three positions.
    """
    n = len(counts)
    flat = made.ravel()

    def lengths(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, made.shape[1]), n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[made].sum(axis=1)

    target = counts.astype(float)
    target[0] = 0
    v = np.ones(len(made))
    for _ in range(20):  # the largest eigenvalue of A'A
        v = back(lengths(v))
        v /= np.linalg.norm(v)
    rate = 1 / (1.05 * np.linalg.norm(back(lengths(v))))
    x = y = np.zeros(len(made))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y + rate * back(target - lengths(y)))
        if ((y - new) @ (new - x)) > 0:  # momentum points uphill
            t, y = 1.0, x
            continue
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, repeats) that pack ``counts`` pieces best-fit by decreasing length, many at a time."""
    open_: list[list[tuple[list[int], int]]] = [[] for _ in range(size + 1)]  # by room
    room = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            at = length + int(np.argmax(room[length:]))
            if room[at]:
                held, n = open_[at].pop()
                used = min(n, left)
                if used < n:
                    open_[at].append((held, n - used))
                room[at] = bool(open_[at])
                held, left = [*held, length], left - used
            else:
                fits = size // length
                used, fits = (left // fits, fits) if left >= fits else (1, left)
                held, left, at = [length] * fits, left - used * fits, size - (fits - 1) * length
            open_[at - length].append((held, used))
            room[at - length] = True
    return [x for held in open_ for x in held]


def rounded(made: np.ndarray, x: np.ndarray, counts: np.ndarray, share: float, up: float) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """floor(share * x + up) repeats of each pattern, the strongest first and never beyond the pieces left; what is left."""
    left, out = counts.copy(), []
    wanted = np.where(x > 1e-9, np.floor(share * x + up), 0).astype(np.int64)
    order = np.argsort(-x, kind="stable")
    for i in order[wanted[order] > 0].tolist():
        held = [n for n in made[i].tolist() if n]
        used = min(int(wanted[i]), *(int(left[n]) // held.count(n) for n in held))
        if used > 0:
            out.append((held, used))
            for n in held:
                left[n] -= used
    return out, left


def plan(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats): fitted patterns, rounded, and the best-fit packing of what they leave.

    ``counts[n]`` pieces have the length n <= ``size``; the plan uses each piece exactly once. Of the roundings in
    ``ROUNDINGS`` that with the fewest sequences is taken: rounding up suits rich histograms, while sparse ones need short
    pieces left for the residual.
    """
    counts = counts.astype(np.int64)
    made = patterns(np.flatnonzero(counts[1:]) + 1, size)
    if not len(made):
        return best_fit(counts, size)
    x = fit(made, counts)
    plans = []
    for share, up in ROUNDINGS:
        exact, left = rounded(made, x, counts, share, up)
        plans.append(exact + best_fit(left, size))
    return min(plans, key=lambda p: sum(n for _, n in p))


def runs_of(planned: list[tuple[list[int], int]]) -> np.ndarray:
    """Columns length, first number, first sequence, offset; one row for each position of a pattern, in this order."""
    rows, following, sequence = [], {}, 0
    for held, n in planned:
        offset = 0
        for length in held:
            first = following.get(length, 0)
            rows.append((length, first, sequence, offset))
            following[length] = first + n
            offset += length
        sequence += n
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with (_part, _class, _k): the k-th piece of its class in its task, for one pass of each task's rows."""
    out = T.StructType([*pieces.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_k", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(CLASSES + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            kinds = batch.column("_class").to_numpy()
            order = np.argsort(kinds, kind="stable")
            of = kinds[order]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            k = np.empty(len(of), np.int64)
            k[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) + seen[of]
            seen += np.bincount(of, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part, np.int32)), pa.array(k)], names=out.fieldNames())

    return pieces.mapInArrow(run, out)


def place(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (``length`` long from 1 to ``size``, any other columns) with sequence_id long and offset long.

    Offsets in a sequence are gapless from 0 and its lengths sum to ``size`` at most. Columns named sequence_id or offset
    are replaced; an empty table stays empty; rows that repeat get places of their own. At sizes beyond ``CLASSES`` plans
    count in steps of size / ``CLASSES`` tokens, so a sequence may leave some room.
    """
    step = -(-size // CLASSES)
    units = size // step
    pieces = pieces.drop("sequence_id", "offset").withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    whole = F.col("length") > units * step  # rounding up would leave the sequence
    kept = stored(numbered(pieces.withColumn("_class", F.when(whole, F.lit(units)).otherwise(F.col("_class")))))
    sums = kept.groupBy("_part", "_class").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(units + 1, np.int64)
    for kind, n in sums.groupBy("_class").agg(F.sum("_n")).collect():  # at most CLASSES rows
        counts[kind] = n
    runs = kept.sparkSession.sparkContext.broadcast(runs_of(plan(counts, units)))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keyed = kept.join(starts, ["_part", "_class"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_part", "_before")
    out = T.StructType([*[f for f in keyed.schema.fields if f.name not in ("_class", "_k")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = runs.value.T
        keys = (length << 48) | first
        for batch in batches:
            k = batch.column("_k").to_numpy()
            at = np.searchsorted(keys, (batch.column("_class").to_numpy().astype(np.int64) << 48) | k, "right") - 1
            columns = [batch.column(f) for f in out.fieldNames()[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + k - first[at]), pa.array(offset[at] * step)], names=out.fieldNames())

    placed = keyed.mapInArrow(run, out)
    if step > 1:  # real lengths are shorter than their classes
        earlier = Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return placed


def sequences(placed: DataFrame) -> DataFrame:
    """One row a sequence: (sequence_id, n_tokens long, ids binary, pieces: array of (offset, length) in order).

    A sequence has ``size`` pieces at most; the pieces keep documents apart in attention masks.
    """
    piece = F.struct("offset", "length", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("_held"))
    joined = F.aggregate("_held", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", F.aggregate("_held", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("n_tokens"), joined.alias("ids"), F.transform("_held", lambda p: F.struct(p["offset"], p["length"])).alias("pieces"))
