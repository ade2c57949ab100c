"""Near-duplicate passages by compact windows.

Texts are sequences of 5-word shingles. A unit is ``UNIT`` shingles in a row. The Cartesian tree over the min-hash values
of a text's units groups all runs of at least ``WINDOW`` units by the unit with the least hash among them: node c with
interval [l, r] stands for every run that begins in [l, c] and ends in [c, r] (equal least units are nodes all), so a
text of n words has about 2 n / WINDOW windows. Windows of different documents with one unit join if their common
interval around it holds a whole run.

One hash function is enough here, whatever the edits: a passage with a similarity of 0.8 differs in at most a ninth of
its shingles, and any edit changes five of them, so at least ``RUN`` = 21 shingles in a row are untouched. These hold
``WINDOW`` whole units, and the least of them is a node with that run in its interval in both texts.

Windows whose shingles are equal as far as a shortest passage can reach form a class, and each meets the first of its
class. The classes of a unit are compared with each other, all with all in blocks, by short hashes of the shingles
around the unit. Of the pairs that share a near passage there, each block gives those of a spanning forest, less those
that an equal run gives at another unit (see ``deferred``) or another pair of blocks (see ``between``). So rows grow with
the windows, however many documents share a passage, and equal and near passages connect all their holders. Joined places are verified on the texts, and passages of ``PASSAGE`` or more words with a
similarity of 0.8 or more are returned. ``passage_classes`` gives every document the class that all such links make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import textnum as N
from tidewire.llm.common import byte_slices, may_match, stored, text_buffer
from tidewire.llm.components import components

SHINGLE, PASSAGE, SIMILARITY = 5, 50, 0.8
#: Shingles of the shortest passage.
LEAST = PASSAGE - SHINGLE + 1
#: Shingles in a row that are equal in any two near passages: 41 of 46 in at most two parts, and more in longer ones.
RUN = 21
#: Shingles of a unit (11 words), and units of a run: the smaller units are, the fewer windows, but the more texts share one.
UNIT = 7
WINDOW = RUN - UNIT + 1
#: Shingles on either side of a window's middle one by which classes are compared: a near passage can be cut into near
#: passages of fewer than 2 * LEAST shingles.
ZONE = 2 * LEAST - 2
#: Shingles, counted from the middle one, of which any near passage has an equal one at some unit. A near passage has a
#: part of ``LEAST`` shingles with at most five unequal ones, and an equal run with a unit in it. Whatever that part's
#: place around the unit's middle, it holds the first two probes or the last two; an edit changes five shingles in a
#: row, so it changes only one of two that lie six apart.
PROBES = (-23, -17, 16, 22)
#: Words in a row that may be inserted or deleted in a shortest passage: with three it isn't similar enough.
SLIP = 2
#: Classes of a unit that one block holds from each of its two sides.
BLOCK = 2048


def compact_windows(h: np.ndarray, least: int = WINDOW) -> list[tuple[int, int, int]]:
    """(l, c, r): the nodes of the Cartesian tree over ``h`` whose interval has at least ``least`` places, inclusive.

    All places of an interval's least hash are nodes with that interval, and the parts between them are divided further,
    so a text that repeats itself costs no more than any other. An explicit stack stands for the recursion.
    """
    out, open_ = [], [(0, len(h))]
    repeats = len(h) >= least and len(np.unique(h)) < len(h)
    while open_:
        lo, hi = open_.pop()
        if hi - lo < least:
            continue
        nodes = [lo + int(h[lo:hi].argmin())]
        if repeats:
            nodes = (lo + np.flatnonzero(h[lo:hi] == h[nodes[0]])).tolist()
        out += [(lo, c, hi - 1) for c in nodes]
        open_ += zip([lo, *(c + 1 for c in nodes)], [*nodes, hi])
    return out


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's 5-word shingles and the rows' bounds; words are lower-cased (A-Z)."""
    starts, ends, rows = N.words(data, offsets)
    counts = np.diff(rows)
    bounds = np.concatenate(([0], np.cumsum(np.maximum(0, counts - SHINGLE + 1))))
    if len(starts) < SHINGLE:
        return np.zeros(0, np.uint64), bounds
    row_of = np.repeat(np.arange(len(counts)), counts)
    got = N.chained(N.span_hashes(N.LOWER[data], starts, ends), SHINGLE)
    return got[row_of[: len(got)] == row_of[SHINGLE - 1 :]], bounds


def interval_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each interval of values (bounds inclusive); equal runs give equal hashes wherever they stand."""
    up, down = N.powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return N.mixed((sums[hi + 1] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(signature long, key, l int, c int, r int, zone long): the compact windows of all documents, in shingles.

    The window's unit begins at shingle c - UNIT // 2. ``zone`` hashes the shingles around c, and their places, as far
    as a shortest passage with c can reach. Of a text's windows with one signature and zone only the first is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                values, bounds = shingles(*text_buffer(part.column(text)))
                units = N.mixed(N.chained(values, UNIT))
                found = [np.zeros((0, 4), np.int64)]
                for d, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    if b - a >= LEAST:
                        own = units[a : b - UNIT + 1]
                        got = np.array(compact_windows(own), np.int64)
                        # Of one word's repetitions the first and the last unit stand for all: what two texts share
                        # inside of them they share from the first on.
                        same = np.concatenate(([False], own[1:] == own[:-1], [False]))
                        got = got[~(same[got[:, 1]] & same[got[:, 1] + 1])]
                        found.append(np.column_stack([np.full(len(got), d), got]))
                d, lo, c, hi = np.concatenate(found).T
                if not len(d):
                    continue
                a, b = bounds[d], bounds[d + 1]
                mark, c, hi = units[a + c], c + UNIT // 2, hi + UNIT - 1
                near, far = np.maximum(0, c - LEAST + 1), np.minimum(b - a - 1, c + LEAST - 1)
                zone = N.mixed(interval_hashes(values, a + near, a + far) + (c - near).astype(np.uint64))
                _, one = np.unique(N.mixed(mark + N.mixed(zone + d.astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(mark[one].view(np.int64)), part.column(key).take(pa.array(d[one])), *(pa.array(x[one].astype(np.int32)) for x in (lo, c, hi)), pa.array(zone[one].view(np.int64))], ["signature", key, "l", "c", "r", "zone"])

    schema = T.StructType([T.StructField("signature", T.LongType()), docs.schema[key], *(T.StructField(x, T.IntegerType()) for x in "lcr"), T.StructField("zone", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def texts_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, name: str) -> DataFrame:
    """(name, <name>_text) of the documents that ``wanted`` names in its column ``name``, and some others."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    return may_match(texts, F.xxhash64("k"), wanted.select(F.xxhash64(name))).groupBy(F.col("k").alias(name)).agg(F.min("t").alias(f"{name}_text"))


def alike_around(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` share with x, place by place, a near passage that holds the middle; 0 equals nothing."""
    same = (many == x) & (x != 0)
    out = np.zeros(len(many), bool)
    some = np.flatnonzero(same.sum(1) * (1 + SIMILARITY) >= LEAST * 2 * SIMILARITY)
    if not len(some):
        return out
    same = same[some]
    sums = np.zeros((len(some), same.shape[1] + 1), np.int16)
    np.cumsum(np.where(same, 1, -8), axis=1, out=sums[:, 1:])
    # Passages begin and end with an equal shingle; the sum may not be less at the end than before the begin.
    begins = np.minimum.accumulate(np.where(same[:, : ZONE + 1], sums[:, : ZONE + 1], 1 << 14), axis=1)
    ends = np.arange(max(ZONE + 1, LEAST), same.shape[1] + 1)
    ok = same[:, ends - 1] & (sums[:, ends] >= begins[:, np.minimum(ZONE, ends - LEAST)])
    out[some] = ok.any(1)
    return out


def shifted_around(x: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` share with x a near passage around the middle in which words were inserted or deleted."""
    lo, hi = ZONE - LEAST + 1, ZONE + LEAST
    out = np.zeros(len(many), bool)
    if not len(many):
        return out
    for one, two in ((x[None], many), (many, x[None])):
        inside = np.any([two[:, lo + d : hi + d] == one[:, lo:hi] for d in range(-SLIP, SLIP + 1)], axis=0) & (one[:, lo:hi] != 0)
        held = np.zeros((len(many), inside.shape[1] + 1), np.int16)
        np.cumsum(inside, axis=1, out=held[:, 1:])
        out |= (held[:, LEAST:] - held[:, :-LEAST]).max(1) >= LEAST * 2 * SIMILARITY / (1 + SIMILARITY) - SLIP
    pad = np.flatnonzero(x)
    for i in np.flatnonzero(out):
        there = np.flatnonzero(many[i])
        a, b = x[pad[0] : pad[-1] + 1], many[i, there[0] : there[-1] + 1]
        out[i] = either_shifted(a, b, ZONE - pad[0], ZONE - there[0]) is not None
    return out


def forest(zones: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that share a near passage around the middle: enough of them to connect all that such pairs connect.

    Each part is reached from its first row on, so the units of one group of texts mostly give the same pairs. Rows are
    compared as a whole only if they agree, up to a shift of ``SLIP``, at one of ``PROBES``: see there. Many rows are
    looked up by their probes, so rows without a near one cost no more than themselves.
    """
    out, reached, left = [], [], np.ones(len(zones), bool)
    probes = np.stack([np.stack([zones[:, ZONE + p + d] for d in range(-SLIP, SLIP + 1)], axis=1) for p in PROBES], axis=1)
    named = np.where(probes != 0, probes.astype(np.uint64) * np.uint64(len(PROBES)) + np.arange(len(PROBES), dtype=np.uint64)[:, None] + np.uint64(1), np.uint64(0))
    order = np.argsort(named, axis=None, kind="stable")
    keys, owners = named.ravel()[order], order // named[0].size if len(zones) else order
    rest, first = len(zones), 0
    while rest:
        if not reached:
            first += int(left[first:].argmax())
            reached, left[first], rest = [first], False, rest - 1
        at = reached.pop()
        mine = named[at, :, SLIP]
        if rest <= 64:
            some = np.flatnonzero(left)
            some = some[((named[some] == mine[:, None]) & (mine != 0)[:, None]).any((1, 2))]
        else:
            mine = mine[mine != 0]
            spans = zip(np.searchsorted(keys, mine, "left").tolist(), np.searchsorted(keys, mine, "right").tolist())
            some = np.concatenate([np.zeros(0, np.int64), *(owners[lo:hi][left[owners[lo:hi]]] for lo, hi in spans)])
            some = np.unique(some)
        if not len(some):
            continue
        near = alike_around(zones[at], zones[some])
        far = np.flatnonzero(~near)
        near[far] = shifted_around(zones[at], zones[some[far]])
        found = some[near]
        out += [(at, int(i)) for i in found]
        reached += found.tolist()
        left[found], rest = False, rest - len(found)
    return out


def between(zones: np.ndarray, block: np.ndarray, blocks: int) -> list[tuple[int, int]]:
    """The pairs that the rows of two of ``blocks`` blocks give: of those inside a block only one of its pairs of blocks
    gives a forest, and between the two only those that join what such forests leave apart."""
    if blocks <= 2:
        return forest(zones)
    out, top = [], list(range(len(zones)))

    def joined(i: int, j: int) -> bool:
        i, j = int(i), int(j)
        while top[i] != i:
            top[i] = i = top[top[i]]
        while top[j] != j:
            top[j] = j = top[top[j]]
        top[j] = i
        return i != j

    sides = np.unique(block).tolist()
    for side in sides:
        rows = np.flatnonzero(block == side)
        own = [(int(rows[i]), int(rows[j])) for i, j in forest(zones[rows])]
        for pair in own:
            joined(*pair)
        out += own if (side + 1) % blocks in sides else []
    return out + [(i, j) for i, j in forest(zones) if block[i] != block[j] and joined(i, j)]


def deferred(x: np.ndarray, y: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which pairs (rows of x and y) another unit gives as well; ``before`` and ``after``: how far y's window reaches from
    the middle.

    If the shingles around the middle that are equal in both reach beyond the window, they hold a unit of less hash. The
    least one of all these shingles, a run of at least ``RUN``, is a window of both texts and in the same passage, so
    there the two are connected, by this rule or by pairs of still less hash.
    """
    same = (x == y) & (x != 0)
    reach = lambda side: np.where(side.all(1), side.shape[1], side.argmin(1)) - 1
    lo, hi = reach(same[:, ZONE::-1]), reach(same[:, ZONE:])
    return (lo + hi + 1 >= RUN) & ((lo > before) | (hi > after))


def near_classes(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """(k, at, o struct<k, at>): pairs of the places (signature, k, c, l, r, n), n to a signature, which share a near passage
    around c: every two places of one signature are compared, and the pairs connect all that do share one."""
    around = stored(places.groupBy("k").agg(F.collect_set(F.struct("signature", "n", "c", (F.col("c") - F.col("l")).alias("before"), (F.col("r") - F.col("c")).alias("after"))).alias("spots")))

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "k_text"):
                values, bounds = shingles(*text_buffer(part.column("k_text")))
                short = np.maximum(1, N.mixed(values) >> np.uint64(32)).astype("<u4")
                spots = part.column("spots")
                rows = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
                spots = spots.flatten()
                c = spots.field("c").to_numpy()
                kept = np.flatnonzero(c < np.diff(bounds)[rows])
                rows, c, spots = rows[kept], c[kept], spots.take(pa.array(kept))
                for lo in range(0, len(rows), 4096):
                    r, mid, some = rows[lo : lo + 4096], c[lo : lo + 4096], spots.slice(lo, 4096)
                    at = (bounds[r] + mid)[:, None] + np.arange(-ZONE, ZONE + 1)
                    held = (at >= bounds[r][:, None]) & (at < bounds[r + 1][:, None])
                    got = np.where(held, short[np.where(held, at, 0)], 0).astype("<u4")
                    yield pa.RecordBatch.from_arrays([some.field("signature"), some.field("n"), part.column("k").take(pa.array(r)), *(some.field(x) for x in ("c", "before", "after")), pa.array([g.tobytes() for g in got], pa.binary())], ["signature", "n", "k", "c", "before", "after", "near"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("signature", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k", kind), *(T.StructField(x, T.IntegerType()) for x in ("c", "before", "after")), T.StructField("near", T.BinaryType())])
    held = around.join(texts_of(docs, key, text, around, "k"), "k").select("k", "spots", "k_text").mapInArrow(zones, schema)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("k", "c"), blocks).cast("int")
    other = held.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).where((blocks == 1) | (F.col("mine") != F.col("other")))
    grouped = other.groupBy("signature", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")).agg(F.sort_array(F.collect_list(F.struct("k", "c", "before", "after", "near", "mine"))).alias("held"), F.first(blocks).alias("blocks")).select("held", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            edges, held = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            near = np.frombuffer(b"".join(held.field("near").to_pylist()), "<u4").reshape(-1, 2 * ZONE + 1)
            before, after, block = (held.field(x).to_numpy() for x in ("before", "after", "mine"))
            pairs = np.array([(lo + i, lo + j) for lo, hi, n in zip(edges, edges[1:], batch.column("blocks").to_pylist()) for i, j in between(near[lo:hi], block[lo:hi], n)], np.int64).reshape(-1, 2)
            for some in np.split(pairs, range(4096, len(pairs), 4096)):
                i, j = some.T
                kept = ~deferred(near[i], near[j], before[j], after[j])
                one, two = held.take(pa.array(i[kept])), held.take(pa.array(j[kept]))
                yield pa.RecordBatch.from_arrays([one.field("k"), one.field("c"), pa.StructArray.from_arrays([two.field("k"), two.field("c")], ["k", "at"])], ["k", "at", "o"])

    at = T.IntegerType()
    met = T.StructType([T.StructField("k", kind), T.StructField("at", at), T.StructField("o", T.StructType([T.StructField("k", kind), T.StructField("at", at)]))])
    return grouped.mapInArrow(run, met).where("k != o.k")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, places array<struct<a_at, b_at>>): documents a > b that may share a passage, and where.

    Rows with a null key are left out; texts that are null or short have no windows; an empty table gives no rows.
    """
    all_ = stored(windows(docs.where(F.col(key).isNotNull()), key, text))
    # What joins is stored first, so that no aggregate stands in a join's stage and a frequent unit can be split.
    shared = stored(all_.groupBy("signature").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first != last").select("signature"))
    rows = stored(all_.join(shared, "signature", "left_semi"))
    place = F.struct(F.col(key).alias("k"), "l", "c", "r")
    classes = stored(rows.groupBy("signature", "zone").agg(F.min(place).alias("rep"), F.max(key).alias("last")))
    own = rows.join(classes.where("rep.k != last"), ["signature", "zone"]).select(F.col(key).alias("k"), F.col("c").alias("at"), F.struct(F.col("rep.k").alias("k"), F.col("rep.c").alias("at")).alias("o"))
    ends = stored(classes.groupBy("signature").agg(F.min("rep").alias("o"), F.max("rep").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    run = F.least(F.col("rep.c") - F.col("rep.l"), F.col("o.c") - F.col("o.l")) + F.least(F.col("rep.r") - F.col("rep.c"), F.col("o.r") - F.col("o.c")) + 1
    two = ends.where((F.col("n") == 2) & (run >= RUN)).select("rep.k", F.col("rep.c").alias("at"), F.struct("o.k", F.col("o.c").alias("at")).alias("o"))
    many = stored(classes.join(ends.where("n > 2").select("signature", "n"), "signature").select("signature", "rep.k", "rep.c", "rep.l", "rep.r", "n"))
    compared = two.unionByName(near_classes(docs, key, text, many))
    met = own.withColumn("equal", F.lit(True)).unionByName(compared.withColumn("equal", F.lit(False))).where("k != o.k")
    turned = F.col("k") < F.col("o.k")
    pair = met.select(F.greatest("k", "o.k").alias("a"), F.least("k", "o.k").alias("b"), F.when(turned, F.col("o.at")).otherwise(F.col("at")).alias("a_at"), F.when(turned, F.col("at")).otherwise(F.col("o.at")).alias("b_at"), "equal")
    # Places of equal zones with one offset that lie within a passage's length are in one passage: the first will do.
    part = F.when(F.col("equal"), F.floor(F.col("a_at") / LEAST)).otherwise(-1 - F.col("a_at"))
    near = pair.groupBy("a", "b", (F.col("b_at") - F.col("a_at")).alias("shift"), part.alias("part")).agg(F.min("a_at").alias("a_at"))
    return near.groupBy("a", "b").agg(F.collect_set(F.struct("a_at", (F.col("a_at") + F.col("shift")).alias("b_at"))).alias("places"))


def side_by_side(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Where a meets b at this offset: first place in a, equal shingles, and their sums (1 for equal, -8 else)."""
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    equal = a[lo:hi] == b[lo + shift : hi + shift]
    return lo, equal, np.concatenate(([0], np.cumsum(np.where(equal, 1, -8))))


def passage(met: tuple[int, np.ndarray, np.ndarray], at: int, shift: int) -> tuple[int, int, int, float] | None:
    """The longest passage around shingle ``at`` of a, side by side with b, with enough similarity, as (first shingle,
    one past the last, offset of b, similarity); None if it is shorter than ``LEAST``.

    m of n shingles side by side being equal is a similarity of m / (2 n - m), which is 0.8 at m = 8 n / 9: the longest
    stretch with a sum of at least 0 where an equal shingle counts 1 and another one -8.
    """
    lo, equal, sums = met
    c = at - lo
    # What differs at either edge isn't part of the passage. Begins from the far left with ever smaller sums before
    # them, ends from the far right with ever larger sums: any other one has a better one outside of it.
    begins, ends = np.flatnonzero(equal[: c + 1]), (np.flatnonzero(equal[c:]) + c + 1)[::-1]
    if not len(begins) or not len(ends):
        return None
    before, after = sums[begins], sums[ends]
    begins = begins[np.concatenate(([True], before[1:] < np.minimum.accumulate(before)[:-1]))]
    ends = ends[np.concatenate(([True], after[1:] > np.maximum.accumulate(after)[:-1]))]
    # For each begin the farthest end whose sum isn't below the sum before it.
    at_end = np.searchsorted(sums[ends], sums[begins], "left")
    begins, at_end = begins[at_end < len(ends)], at_end[at_end < len(ends)]
    if not len(begins):
        return None
    longest = int((ends[at_end] - begins).argmax())
    begin, end = int(begins[longest]), int(ends[at_end[longest]])
    n = end - begin
    if n < LEAST:
        return None
    m = int(equal[begin:end].sum())
    return begin + lo, end + lo, shift, m / (2 * n - m)


def shifted_passage(a: np.ndarray, b: np.ndarray, at: int, bt: int) -> tuple[int, int, int, float] | None:
    """A shortest passage around the shingle whose sets of shingles are similar enough, though words were inserted or
    deleted in it."""
    lo, lo_b = max(0, at - LEAST + 1), max(0, bt - LEAST - SLIP + 1)
    inside = (a[lo : at + LEAST, None] == b[lo_b : bt + LEAST + SLIP]).any(1)
    if len(inside) < LEAST:
        return None
    held = np.cumsum(np.concatenate(([0], inside)))
    held = held[LEAST:] - held[:-LEAST]
    if held.max() < LEAST * 2 * SIMILARITY / (1 + SIMILARITY) - SLIP:
        return None
    s = lo + int(held.argmax())
    x, base = a[s : s + LEAST], s + bt - at
    start = max(0, base - SLIP)
    y = b[start : max(start, base + LEAST + 2 * SLIP)]
    slips, inside = np.arange(-SLIP, SLIP + 1), (y[:, None] == x).any(1)
    begins = base - start + slips
    ends = begins + LEAST + slips[:, None]  # rows: how much longer the part of b is; columns: where it begins
    to, here = np.minimum(np.maximum(ends, 0), len(y)), np.minimum(np.maximum(begins, 0), len(y))
    if len(set(y.tolist())) == len(y):
        held = np.concatenate(([0], np.cumsum(inside)))
        own, both = to - here, held[to] - held[here]
    else:  # a shingle counts in a part of b if it stands there for the first time
        order = np.argsort(y, kind="stable")
        before = np.full(len(y), -1)
        before[order[1:]] = np.where(y[order[1:]] == y[order[:-1]], order[:-1], -1)
        first = (before < begins[:, None]) & (np.arange(len(y)) >= begins[:, None])
        sums = np.zeros((2, len(begins), len(y) + 1), np.int64)
        np.cumsum(np.stack([first, first & inside]), axis=2, out=sums[:, :, 1:])
        own, both = sums[:, np.arange(len(begins)), to]
    alike = np.where((begins >= 0) & (ends <= len(y)), both / (len(set(x.tolist())) + own - both), -1)
    best = int(alike.argmax())
    if alike.flat[best] < SIMILARITY:
        return None
    return s, s + LEAST, int(base + slips[best % len(slips)] - s), float(alike.flat[best])


def either_shifted(a: np.ndarray, b: np.ndarray, at: int, bt: int) -> tuple[int, int, int, float] | None:
    """``shifted_passage`` from a's side, else from b's: whether two texts share one doesn't depend on their order."""
    got = shifted_passage(a, b, at, bt)
    if got is None and (turned := shifted_passage(b, a, bt, at)):
        s, e, shift, alike = turned
        got = (s + shift, e + shift, -shift, alike) if e + shift <= len(a) else None
    return got


def verified(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """Near-duplicate passages (words from, to, offset of b, similarity) around the places; a place of a that lies in a
    passage already found isn't looked at again."""
    out: list[tuple[int, int, int, float]] = []
    met: dict[int, tuple] = {}
    for at, bt in sorted(places, key=lambda p: (p[1] - p[0], p[0])):
        if any(s <= at < e for s, e, _, _ in out):
            continue
        if bt - at not in met:
            met = {bt - at: side_by_side(a, b, bt - at)}
        got = passage(met[bt - at], at, bt - at) or either_shifted(a, b, at, bt)
        if got:
            out.append(got)
    return [(s, e + SHINGLE - 1, shift, alike) for s, e, shift, alike in out]


PASSAGES = "start_word int, end_word int, other_start int, other_end int, similarity double"


def near_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, other_<key>, start_word, end_word, other_start, other_end, similarity): passages of at least ``PASSAGE``
    words of a document that stand, with a similarity of at least 0.8 on 5-word shingles, in another one of lower key.

    Word ranges exclude their end. A passage that many documents share is given once for each of them, against the
    first or last document that has it, so the rows connect all its documents. Texts that are null or short have no
    rows, nor have rows with a null key or a document's own repeats; rows with one key are taken as one document, by
    the first of their texts in order. An empty table gives an empty result.
    """
    found = stored(candidates(docs, key, text))
    # Stored, so that no aggregate stands in a join's stage and a text that very many others meet can be split.
    texts = stored(texts_of(docs, key, text, found.select(F.explode(F.array("a", "b")).alias("k")), "k"))
    of = lambda side: texts.select(F.col("k").alias(side), F.col("k_text").alias(f"{side}_text"))
    both = found.join(of("a"), "a").join(of("b"), "b").select("a", "b", "places", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "b_text"):
                x, xb = shingles(*text_buffer(part.column("a_text")))
                lower = part.column("b_text").dictionary_encode()  # many meet one first document: hashed once
                y, yb = shingles(*text_buffer(lower.dictionary))
                lower, at, rows = lower.indices.to_numpy(), [], []
                for i, places in enumerate(part.column("places").to_pylist()):
                    for s, e, shift, alike in verified(x[xb[i] : xb[i + 1]], y[yb[lower[i]] : yb[lower[i] + 1]], [(p["a_at"], p["b_at"]) for p in places]):
                        at.append(i)
                        rows.append((int(s), int(e), int(s + shift), int(e + shift), float(alike)))
                if rows:
                    cols = list(zip(*rows))
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.float64())], schema.names)

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(f"other_{key}", kind), *T._parse_datatype_string(PASSAGES).fields])
    return both.mapInArrow(run, schema)


def passage_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id, passages): one row per document with its class, the least key that near passages lead to from
    it, and its passages of ``near_passages`` (array of structs; null: none of a document of lower key).

    Links to different texts are all in the class, also those that ``near_passages`` leaves to a chain of others. Rows with
    a null key are left out.
    """
    found = stored(near_passages(docs, key, text))
    other = f"other_{key}"
    root = components(found.select(F.col(key).alias("src"), F.col(other).alias("dst")).distinct())
    least = root.groupBy("root").agg(F.min("node").alias("component_id"))
    placed = root.join(least, "root").select(F.col("node").alias(key), "component_id")
    fields = F.struct("start_word", "end_word", other, "other_start", "other_end", "similarity")
    held = found.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("passages"))
    every = docs.where(F.col(key).isNotNull()).select(key).distinct()
    return every.join(placed, key, "left").join(held, key, "left").select(key, F.coalesce("component_id", key).alias("component_id"), "passages")
