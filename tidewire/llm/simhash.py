"""SimHash fingerprints and an exact near-duplicate join over a Gray-order hierarchical index.

Fingerprints within ``k`` bits agree exactly on at least one choice of ``blocks - k`` out of ``blocks`` bit blocks. Each
choice is one copy of the index; its top nodes are the agreed bits (so their accumulated difference is 0). Below a top
node the fingerprints stand in order of their Gray rank, where neighbours share long masked patterns; upper nodes hold
the bits all members share, and a pair of nodes is dropped with all below it once the shared bits differ in more than
``k`` places. Top nodes with many different fingerprints are spread over tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_slices, saved, text_buffer
from tidewire.llm.components import components, stars

SHINGLE, SEED, BITS = 3, 42, 64
#: Different fingerprints of one top node that one tile holds from each side.
TILE = 1024
LEAF = 32


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # of bytes: only A-Z, and white space is 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint_rows(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each row: bit j is 1 if it is set in over half of the row's hashes; no hashes: 0."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.sum(weights[counts * 2 > len(h)], dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long: the 64 bits, two's complement) for each row; null and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                data, offsets = text_buffer(part.column(text))
                raw, at = data.tobytes(), offsets.tolist()
                fps = fingerprint_rows([shingle_hashes(raw[a:b]) for a, b in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fps.view(np.int64))], [key, "fp"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("fp", T.LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(x: np.ndarray, fan: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """(and, or) of each node, leaf blocks first; upper nodes join ``fan`` neighbours."""
    at = np.arange(0, len(x), LEAF)
    levels = [(np.bitwise_and.reduceat(x, at), np.bitwise_or.reduceat(x, at))]
    while len(levels[-1][0]) > 1:
        both, some = levels[-1]
        at = np.arange(0, len(both), fan)
        levels.append((np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(some, at)))
    return levels


def close_pairs(x: np.ndarray, k: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all pairs of ``x``, which stands in Gray order, that differ in at most ``k`` bits."""
    levels = _levels(x, fan)
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        both, some = levels[depth]
        shared = ~(both[a] ^ some[a]) & ~(both[b] ^ some[b])
        near = np.bitwise_count((both[a] ^ both[b]) & shared) <= k
        a, b = a[near], b[near]
        if depth:
            n, child = len(levels[depth - 1][0]), np.arange(fan)
            left, right = (a[:, None, None] * fan + child[:, None]), (b[:, None, None] * fan + child[None, :])
            left, right = np.broadcast_arrays(left, right)
            ok = (left < n) & (right < n) & (left <= right)
            a, b = left[ok], right[ok]
    found_i, found_j, n, child = [], [], len(x), np.arange(LEAF)
    for lo in range(0, len(a), 512):
        i = (a[lo : lo + 512, None] * LEAF + child)[:, :, None]
        j = (b[lo : lo + 512, None] * LEAF + child)[:, None, :]
        hit = (np.bitwise_count(x[np.minimum(i, n - 1)] ^ x[np.minimum(j, n - 1)]) <= k) & (i < j) & (j < n)
        where = np.nonzero(hit)
        found_i.append(i[where[0], where[1], 0])
        found_j.append(j[where[0], 0, where[2]])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (a[:0], b[:0])


def _linked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Links inside each group of a partition whose rows are (g1, g2, g3, fp)."""
    cols = [[], [], [], []]
    for batch in batches:
        for c, name in zip(cols, ("g1", "g2", "g3", "fp")):
            c.append(batch.column(name).to_numpy(zero_copy_only=False))
    if not cols[0]:
        return
    g1, g2, g3, fp = map(np.concatenate, cols)
    fp = fp.view(np.uint64)
    order = np.lexsort((gray_rank(fp), g3, g2, g1))
    g1, g2, g3, fp = g1[order], g2[order], g3[order], fp[order]
    first = np.ones(len(fp), bool)
    first[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]) | (g3[1:] != g3[:-1])
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(fp)))
    small = sizes[group] <= LEAF
    src, dst = [], []
    for d in range(1, LEAF):
        same = small[:-d] & (group[:-d] == group[d:])
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= k]
        src.append(fp[at + d])
        dst.append(fp[at])
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        x = fp[s : s + n]
        i, j = stars(*close_pairs(x, k), int(n))
        src.append(x[i])
        dst.append(x[j])
    if src:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (src, dst)], ["src", "dst"])


def _masks(blocks: int, k: int) -> list[int]:
    edge = [round(b * BITS / blocks) for b in range(blocks + 1)]
    part = [((1 << edge[b + 1]) - 1) ^ ((1 << edge[b]) - 1) for b in range(blocks)]
    return [sum(part[b] for b in chosen) for chosen in combinations(range(blocks), blocks - k)]


#: Different fingerprints that a top node may be expected to hold before the index takes more blocks.
NODE = 4096


def blocks_for(n: int, k: int = 3) -> int:
    """The fewest blocks with which ``n`` fingerprints leave about ``NODE`` in a top node: 4 up to some 10^8, then 5."""
    blocks = k + 1
    while blocks < 2 * k and n > NODE << (BITS * (blocks - k) // blocks):
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(distinct: DataFrame, k: int = 3, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst) links over different fingerprints (column fp), as connected as all pairs within ``k`` bits.

    With ``blocks`` b, top nodes agree on b - k blocks; more blocks give smaller top nodes and more copies, for inputs
    of many billions of fingerprints. A top node with n fingerprints is spread over about (n / tile)^2 / 2 tiles, so
    a task reads tiles of bounded size however many fingerprints agree there; no pair is left out.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(blocks, k)])
    top = distinct.select("fp", F.posexplode(masks).alias("g1", "mask")).select("fp", "g1", F.col("fp").bitwiseAND(F.col("mask")).alias("g2"))
    sizes = top.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    own: Column = F.pmod(F.xxhash64("fp"), chunks)
    rows = top.join(sizes, ["g1", "g2"]).withColumn("c", chunks).withColumn("own", own)
    # Tile (a, b), a <= b, compares chunk a with chunk b; a chunk meets itself in its tile with every other one too.
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda o: F.least(o, F.col("own")) * F.col("c") + F.greatest(o, F.col("own")))
    tiles = rows.select("g1", "g2", F.explode(others).alias("g3"), "fp")
    dealt = tiles.repartition("g1", "g2", "g3").select(F.col("g1").cast("long").alias("g1"), "g2", "g3", "fp")
    return dealt.mapInArrow(lambda it: _linked(it, k), "src long, dst long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(key, fingerprint string of 16 hex digits, component_id): rows that links of at most ``k`` bits connect share
    the smallest key among them.

    Rows with equal fingerprints (blank and null texts have 0) count once in the search. Rows with a null key get the
    component's smallest non-null key (null if there is none). Repeated keys and other columns do no harm.
    """
    found = saved(fingerprints(df, key, text))
    rooted = _rooted(saved(found.groupBy("fp").agg(F.min(key).alias("first"))), k)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    byfp = rooted.join(least, "root").select("fp", "component_id")
    return found.join(byfp, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(firsts: DataFrame, k: int) -> DataFrame:
    """The rows of ``firsts`` (fp and first, a row for each fingerprint) with their component's root."""
    roots = components(fingerprint_links(firsts.select("fp"), k, blocks_for(firsts.count(), k)))
    return saved(firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """One whole row of each component of ``near_duplicates``: the first by key (null first), then by a hash of the
    text, then (rows that repeat both) by a hash of the other columns.

    A row with a null key stays if its text is like no other's; blank and null texts are one component.
    """
    row = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    name, said = F.col("row").getField(key), F.xxhash64(F.col("row").getField(text))
    marks = fingerprints(df.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("id"), F.col(text).alias("t")), "id", "t")
    firsts = saved(marks.groupBy("fp").agg(F.min("id").alias("first")))
    chosen = _rooted(firsts, k).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("k"), F.col("first.h").alias("h"))
    kept = row.join(chosen, name.eqNullSafe(F.col("k")) & (said == F.col("h")), "left_semi")
    one = Window.partitionBy(name, said).orderBy(F.xxhash64("row"))
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
