"""Hard negatives from one-dimensional distance keys.

The rows with the largest inner products with an anchor are its nearest rows, once each row x gets a further component
sqrt(M^2 - |x|^2) (M: the longest row) and the anchor q a zero: d^2 = |q|^2 + M^2 - 2 <q, x>.

1. Each augmented row goes to its nearest pivot; its key is (pivot, distance to it). Rows are range-partitioned and stored
   sorted by key, in blocks of at most ``ROWS``; a directory holds each block's interval of keys (``Index``).
2. A search looks for rows within a radius r of an anchor: by the triangle inequality these have keys in
   [d(q, pivot) - r, d(q, pivot) + r], for each pivot. Queries whose anchors lie together form a group; groups and the
   blocks that any of their intervals meets are joined, and each pair of group and block is one matrix product.
3. With k rows found, the distance of the k-th bounds what can be missed: if it is within r, the result is certain, else
   it is the next radius. With fewer rows the radius grows. A block that was scanned is not scanned again: only the
   annulus between the old and the new radius is. The last round takes the bound that nothing exceeds, so every result is
   exact.

A score bound from above (negatives must not be nearer than that) skips blocks that lie inside the inner radius as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import stored

#: Rows of a block, queries of a group, pivots.
ROWS, QUERIES, PIVOTS = 1024, 512, 64
#: Pivots and first radii are fitted on at most so many rows (those with the smallest hash of their key) and bytes.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Factors of the radius where fewer than k rows were found; after them all is scanned.
GROWTH = (1.1, 1.2, 1.4)
#: Squared length of a row, from which integer scores and their multiples might leave a long.
LONGEST = float(1 << 56)
NO_BOUND = 1 << 62


def integer_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, v: floor(scale * x) of each component) of the rows that take part, one for each key.

    Rows with a null key, label or vector, or any null or non-finite component take no part. Of rows that repeat a key
    the smallest by label, then by components, stands for all. Other columns are not read.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.struct(F.col(label).cast("long").alias("label"), v.alias("v")).alias("_row"))
    return rows.groupBy("vec_id").agg(F.min("_row").alias("_row")).select("vec_id", "_row.label", "_row.v")


@dataclass(frozen=True)
class Space:
    """What tasks know of the index; its size doesn't depend on the number of rows."""

    dims: int
    kind: str
    longest: float  # M^2
    pivots: np.ndarray  # augmented
    sample: np.ndarray
    sample_labels: np.ndarray
    sample_share: float

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + self.longest**0.5)

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Integer rows of packed vectors."""
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.dims)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact integer inner products, in floating point where no sum can leave 53 bits."""
        if self.longest < 2.0**52:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T

    def to_pivots(self, vectors: np.ndarray, further: np.ndarray) -> np.ndarray:
        x = vectors.astype(float)
        own = (x * x).sum(axis=1) + further**2
        near = x @ self.pivots[:, :-1].T + further[:, None] * self.pivots[:, -1]
        return np.sqrt(np.maximum(0, own[:, None] + (self.pivots**2).sum(axis=1) - 2 * near))

    def distance(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, norm + self.longest - 2.0 * score))


def fitted_pivots(points: np.ndarray, n: int, steps: int = 6) -> np.ndarray:
    """Centres of ``points``: farthest-first seeds, then Lloyd steps."""
    seeds, nearest = [0], np.full(len(points), np.inf)
    while len(seeds) < min(n, len(points)):
        nearest = np.minimum(nearest, ((points - points[seeds[-1]]) ** 2).sum(axis=1))
        if nearest.max() <= 0:
            break
        seeds.append(int(nearest.argmax()))
    centres = points[seeds]
    for _ in range(steps):
        own = ((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(held[:, None] > 0, sums / np.maximum(1, held)[:, None], centres)
    return centres


class Index:
    """Augmented rows, stored sorted by (pivot, distance) in blocks, and the directory of the blocks."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows``: (vec_id long, label long, v array of longs), each vec_id once; shorter vectors count as zero-padded."""
        self.rows = rows
        squared = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
        n, longest, dims, largest = rows.agg(F.count(F.lit(1)), F.max(squared), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
        self.n = n
        if not n:
            return
        if longest >= LONGEST:
            raise ArithmeticError(f"a vector's squared length {longest:g} is beyond {LONGEST:g}: scores would not fit a long")
        dims = max(1, dims)
        kind = next(k for k, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if (largest or 0) < most)
        most = max(PIVOTS, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
        vectors = np.zeros((len(sample), dims), np.int64)
        for i, row in enumerate(sample):
            vectors[i, : len(row.v)] = row.v
        further = np.sqrt(np.maximum(0, longest - (vectors.astype(float) ** 2).sum(axis=1)))
        pivots = fitted_pivots(np.column_stack([vectors, further]).astype(float), PIVOTS)
        self.space = Space(dims, kind, float(longest), pivots, vectors, np.array([r.label for r in sample]), len(sample) / n)
        self.shared = rows.sparkSession.sparkContext.broadcast(self.space)
        self.blocks = stored(self._blocks())
        self.directory = self.blocks.select("block", "pivot", "lo", "hi")

    def packed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``vec`` binary in place of ``v``, norm (squared) and the key (pivot, dist) of the augmented row."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for batch in batches:
                v = batch.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy()
                vectors = np.zeros((len(v), space.dims), space.kind)
                vectors[np.repeat(np.arange(len(v)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                norm = (vectors.astype(float) ** 2).sum(axis=1)
                far = space.to_pivots(vectors, np.sqrt(np.maximum(0, space.longest - norm)))
                pivot = far.argmin(axis=1)
                vec = pa.array([x.tobytes() for x in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vec, pa.array(norm), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot])], names=["vec_id", "label", "vec", "norm", "pivot", "dist"])

        return rows.mapInArrow(run, "vec_id long, label long, vec binary, norm double, pivot int, dist double")

    def _blocks(self) -> DataFrame:
        keyed = self.packed(self.rows).drop("norm")
        ordered = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, part = 0, TaskContext.get().partitionId()
            for rows in chunks(batches, ROWS, "pivot"):
                number = lambda name, kind: rows.column(name).to_numpy().astype(kind).tobytes()
                dist = rows.column("dist").to_numpy()
                values = [(part << 32) | made, rows.column("pivot")[0].as_py(), float(dist[0]), float(dist[-1]), number("vec_id", "<i8"), number("label", "<i8"), b"".join(rows.column("vec").to_pylist())]
                made += 1
                yield pa.RecordBatch.from_pylist([dict(zip(BLOCK.names, values))], schema=BLOCK)

        return ordered.mapInArrow(run, "block long, pivot int, lo double, hi double, ids binary, labels binary, vecs binary")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of each query: (anchor_id, bound, vec_id, score), by score descending, then vec_id.

        ``queries`` holds (anchor_id, bound: any number that tells an anchor's queries apart, label, vec, norm, pivot,
        dist, low, high): scores from low to high count, of rows of the same label (``same``) or of other labels, never
        the anchor itself.
        """
        key, space = ["anchor_id", "bound"], self.space
        state, found = stored(self._started(queries, k, same)), None
        for step in range(len(GROWTH) + 2):
            groups = stored(self._groups(state))
            hits = self._scanned(groups, k, same)
            hits = hits if found is None else hits.unionByName(found)
            best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
            found = stored(hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n"))
            seen = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_last"))
            full = F.coalesce(F.col("_n"), F.lit(0)) >= k
            reach: Column = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + space.longest - 2.0 * F.col("_last"))) + space.slack
            more = F.lit(float("inf")) if step >= len(GROWTH) else F.col("r") * GROWTH[step] + space.slack
            wanted = F.when(full, reach).otherwise(F.least(F.col("outer"), more))
            state = state.join(seen, key, "left").withColumn("_next", wanted).where((F.col("r") < F.col("outer")) & (F.col("_next") > F.col("r")))
            least = F.when(full, F.greatest("least", "_last")).otherwise(F.col("least"))
            state = stored(state.withColumn("before", F.col("r")).withColumn("r", F.col("_next")).withColumn("least", least).drop("_n", "_last", "_next"))
            if state.isEmpty():
                break
        return found

    def _started(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """Queries with their bounds as distances and a first radius, in which the sample expects 2 k rows."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            rank = max(1, int(np.ceil(2 * k * space.sample_share)))
            for batch in batches:
                norm, low, high = (batch.column(c).to_numpy() for c in ("norm", "low", "high"))
                label = batch.column("label").to_numpy()
                score = space.products(space.matrix(batch.column("vec")), space.sample).astype(float)
                fits = ((label[:, None] == space.sample_labels) == same) & (score >= low[:, None]) & (score <= high[:, None])
                score[~fits] = -np.inf
                nth = np.sort(score, axis=1)[:, -rank] if score.shape[1] >= rank else np.full(len(score), -np.inf)
                outer = np.where(low <= -NO_BOUND, np.inf, space.distance(norm, low) + space.slack)
                r = np.minimum(outer, np.where(np.isfinite(nth), space.distance(norm, np.where(np.isfinite(nth), nth, 0)) + space.slack, np.inf))
                inner = np.where(high >= NO_BOUND, 0, space.distance(norm, np.minimum(high, NO_BOUND)) - space.slack)
                more = [pa.array(c) for c in (inner, outer, np.full(len(r), -1.0), r, low)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "inner", "outer", "before", "r", "least"])

        names = ["anchor_id", "bound", "label", "vec", "norm", "pivot", "dist", "low", "high"]
        return queries.select(*names).mapInArrow(run, STATE)

    def _groups(self, state: DataFrame) -> DataFrame:
        """Queries of neighbouring anchors, packed, with the keys that each pivot must be searched in."""
        shared = self.shared
        ordered = state.repartitionByRange("pivot", "dist", "anchor_id", "bound").sortWithinPartitions("pivot", "dist", "anchor_id", "bound")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, made, part = shared.value, 0, TaskContext.get().partitionId()
            for rows in chunks(batches, QUERIES):
                number = lambda name: rows.column(name).to_numpy()
                vectors = space.matrix(rows.column("vec"))
                far = space.to_pivots(vectors, np.zeros(len(vectors)))
                r, before, inner = (number(c)[:, None] for c in ("r", "before", "inner"))
                least = np.maximum(far - r, inner - far).min(axis=0)
                most = (far + r).max(axis=0)
                # Blocks that every query has scanned before.
                seen = (before >= 0).all()
                seen_least = (far - before).max(axis=0) if seen else np.full(far.shape[1], np.inf)
                seen_most = (far + before).min(axis=0) if seen else np.full(far.shape[1], -np.inf)
                spans = [{"pivot": p, "a": a, "b": b, "c": c, "d": d} for p, (a, b, c, d) in enumerate(zip(least.tolist(), most.tolist(), seen_least.tolist(), seen_most.tolist()))]
                values = [(part << 32) | made, spans, *(number(c).tobytes() for c in PACKED), b"".join(rows.column("vec").to_pylist())]
                made += 1
                yield pa.RecordBatch.from_pylist([dict(zip(GROUP.names, values))], schema=GROUP)

        packed = ", ".join(f"{c} binary" for c in PACKED)
        return ordered.mapInArrow(run, f"group long, spans array<struct<pivot int, a double, b double, c double, d double>>, {packed}, vec binary")

    def _scanned(self, groups: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` rows of each query in each block that its group meets for the first time."""
        shared = self.shared
        spans = groups.select("group", F.inline("spans"))
        meets = (F.col("hi") >= F.col("a")) & (F.col("lo") <= F.col("b")) & ~((F.col("hi") >= F.col("c")) & (F.col("lo") <= F.col("d")))
        pairs = spans.join(self.directory, "pivot").where(meets).select("group", "block")
        paired = pairs.join(groups.drop("spans"), "group").join(self.blocks, "block").drop("group", "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    cell = {c: batch.column(c)[i] for c in batch.schema.names}
                    buffer = lambda name, kind: np.frombuffer(cell[name].as_buffer(), kind)
                    anchor, bound, of, low, high, least = (buffer(c, "<i8") for c in ("anchor_id", "bound", "label", "low", "high", "least"))
                    before, r, inner = (buffer(c, "<f8") for c in ("before", "r", "inner"))
                    vectors = buffer("vec", space.kind).reshape(len(anchor), space.dims)
                    ids, labels = buffer("ids", "<i8"), buffer("labels", "<i8")
                    rows = buffer("vecs", space.kind).reshape(len(ids), space.dims)
                    pivot, lo, hi = (cell[c].as_py() for c in ("pivot", "lo", "hi"))
                    far = space.to_pivots(vectors, np.zeros(len(vectors)))[:, pivot]
                    meets = (hi >= far - r) & (lo <= far + r) & (hi + far >= inner)
                    meets &= (before < 0) | (hi < far - before) | (lo > far + before)
                    asked = np.flatnonzero(meets)
                    if not len(asked):
                        continue
                    _, first, which = np.unique(anchor[asked], return_index=True, return_inverse=True)
                    scores = space.products(vectors[asked[first]], rows)
                    out: list[tuple[np.ndarray, ...]] = []
                    for q, a in zip(asked, which):
                        score = scores[a]
                        at = np.flatnonzero((score >= max(low[q], least[q])) & (score <= high[q]) & ((labels == of[q]) == same) & (ids != anchor[q]))
                        if len(at) > k:
                            at = at[score[at] >= np.partition(score[at], -k)[-k]]
                        at = at[np.lexsort((ids[at], -score[at]))][:k]
                        if len(at):
                            out.append((np.full(len(at), anchor[q]), np.full(len(at), bound[q]), ids[at], score[at]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "bound", "vec_id", "score"])

        return paired.mapInArrow(run, "anchor_id long, bound long, vec_id long, score long")


BLOCK = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vecs", pa.binary())])
PACKED = ("anchor_id", "bound", "label", "low", "high", "least", "before", "r", "inner")
SPAN = pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in "abcd")])
GROUP = pa.schema([("group", pa.int64()), ("spans", pa.list_(SPAN)), *((c, pa.binary()) for c in PACKED), ("vec", pa.binary())])
STATE = "anchor_id long, bound long, label long, vec binary, norm double, pivot int, dist double, low long, high long, inner double, outer double, before double, r double, least long"


def chunks(batches: Iterator[pa.RecordBatch], size: int, by: str | None = None) -> Iterator[pa.Table]:
    """Tables of at most ``size`` consecutive rows, which agree in ``by``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        while held.num_rows:
            of = held.column(by).to_numpy() if by else np.zeros(held.num_rows)
            same = int(np.searchsorted(of, of[0], "right"))
            n = min(size, same)
            if n == held.num_rows:
                break  # the next batch may go on with it
            if n < size and not by:
                break
            yield held.slice(0, n).combine_chunks()
            held = held.slice(n)
        if not held.num_rows:
            held = None
    while held is not None and held.num_rows:
        yield held.slice(0, size).combine_chunks()
        held = held.slice(size)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score, negative_score) of every anchor and positive.

    ``rows``: as ``integer_rows`` gives them; anchors are those for which ``anchors`` holds. An anchor's positives are the
    first ``positives`` other rows of its label; negatives are the first ``negatives`` rows of other labels with scores
    from ``least`` to ``most`` hundredths of the positive's. Scores are integer inner products; higher ones come first,
    ties by the smaller key. Anchors without positives, positives without negatives (all of negative score) and an
    empty table give no rows.
    """
    rows = stored(rows)
    index = Index(rows)
    if not index.n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = stored(index.packed(rows.where(anchors)).withColumnRenamed("vec_id", "anchor_id"))
    unbounded = asked.withColumns({"bound": F.lit(0).cast("long"), "low": F.lit(-NO_BOUND).cast("long"), "high": F.lit(NO_BOUND).cast("long")})
    near = index.search(unbounded, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound"))
    # div truncates, so bounds are taken of non-negative scores alone: below zero no score lies in between.
    bounds = near.where("bound >= 0").select("anchor_id", "bound").distinct()
    bounds = bounds.withColumn("low", F.expr(f"({least} * bound + 99) div 100")).withColumn("high", F.expr(f"{most} * bound div 100"))
    found = index.search(bounds.join(asked, "anchor_id"), negatives, False)
    best = Window.partitionBy("anchor_id", "bound").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    out = near.join(ranked, ["anchor_id", "bound"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))
