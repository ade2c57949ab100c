"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c). Turned onto their principal dimensions, vectors
are sorted by grid cells on the leading ones; the sequence is cut into blocks with bounding boxes, and pairs of blocks
whose boxes are within eps are joined.

Inside a pair of blocks the principal dimensions are dealt into groups of about ``GROUP``. A pair within eps is within
eps / sqrt(groups) in at least one group, where cells are small beside the vectors' spread: for each group both blocks
are put into its epsilon grid order, and their intervals are joined from the whole down to ``LEAF`` vectors, skipping
intervals whose boxes are too far apart. What is left is verified on the whole vectors. Equal vectors count once in the
join; vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import saved
from tidewire.llm.components import components, stars

#: Principal dimensions of the blocks' boxes, and the leading ones whose cells order the sequence.
LEAD, ORDERED = 8, 4
#: Dimensions of a group inside a pair of blocks, about.
GROUP = 16
LEAF, FAN = 64, 4
#: A block has a fixed share of the vectors, so that the join has tasks for all cores, but at least and at most so many bytes.
SHARE, LEAST_BYTES, MOST_BYTES = 8, 1 << 19, 16 << 20
#: Vectors of one length that hold no more numbers than these are compared in one task.
SMALL = 1 << 17
#: Longer vectors are not turned, as dim x dim numbers reach the driver and the tasks.
TURNED = 1024


def _matrix(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(-1, dim)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, raw binary: little-endian doubles of the unit vector) of the rows that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, v in enumerate(batch.column(vector)):
                if v.is_valid and batch.column(key)[i].is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy().astype("<f8")
                    most = np.abs(x).max()
                    if np.isfinite(x).all() and most > 0:
                        x = x / most  # keeps the squares of huge and tiny components in range
                        rows.append(((x / np.sqrt(x @ x)) + 0.0).astype("<f8").tobytes())
                        at.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(rows, pa.binary())], [key, "raw"])

    return df.select(key, vector).mapInArrow(run, T.StructType([df.schema[key], T.StructField("raw", T.BinaryType())]))


def principal_dimensions(vectors: DataFrame, dim: int) -> np.ndarray:
    """The principal directions (dim x dim, by falling variance) of all vectors; only dim x dim sums reach the driver.
    No vectors, or vectors longer than ``TURNED``, stay as they are."""
    if dim > TURNED:
        return np.eye(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("raw"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["moments"])

    sums = vectors.select("raw").mapInArrow(run, "moments array<double>").select(F.posexplode("moments").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    if not sums.num_rows:
        return np.eye(dim)
    _, directions = np.linalg.eigh(sums.column("v").to_numpy().reshape(dim, dim))
    return np.ascontiguousarray(directions[:, ::-1])


def dimension_groups(dim: int) -> list[np.ndarray]:
    """The principal dimensions dealt in turn, so that the groups spread alike."""
    m = max(1, dim // GROUP)
    return [np.arange(g, dim, m) for g in range(m)]


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes (low, high) of the sequence's intervals, leaves first; upper ones join ``FAN`` neighbours."""
    at = np.arange(0, len(x), LEAF)
    levels = [(np.minimum.reduceat(x, at), np.maximum.reduceat(x, at))]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        at = np.arange(0, len(lo), FAN)
        levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    return levels


def near_leaves(x: np.ndarray, y: np.ndarray, eps2: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two sequences (of one: first <= second) whose boxes are within eps, from the top down."""
    one, two = _levels(x), _levels(y)
    a = b = np.zeros(1, np.int64)
    for depth in range(max(len(one), len(two)) - 1, -1, -1):
        (alo, ahi), (blo, bhi) = one[min(depth, len(one) - 1)], two[min(depth, len(two) - 1)]
        kept_a, kept_b = [a[:0]], [b[:0]]
        for lo in range(0, len(a), 1 << 16):
            i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            gap = np.maximum(0, np.maximum(alo[i] - bhi[j], blo[j] - ahi[i]))
            near = np.einsum("ij,ij->i", gap, gap) <= eps2
            kept_a.append(i[near])
            kept_b.append(j[near])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        if depth:
            below = [len(levels[depth - 1][0]) if depth < len(levels) else 0 for levels in (one, two)]
            step = [np.arange(FAN) if n else np.zeros(1, np.int64) for n in below]
            i, j = np.broadcast_arrays((a[:, None, None] * len(step[0]) + step[0][:, None]), (b[:, None, None] * len(step[1]) + step[1][None, :]))
            ok = (i < (below[0] or len(one[-1][0]))) & (j < (below[1] or len(two[-1][0])))
            if same:
                ok = ok & (i <= j)
            a, b = i[ok], j[ok]
    return a, b


def ego_pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, same: bool, compared: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b; i < j if both are the same sequence) with a cosine of at least ``cosine``, each once;
    pa_, pb: the vectors on their principal dimensions. ``compared`` collects how many pairs the leaves compared."""
    if not len(a) or not len(b):
        return
    groups = dimension_groups(a.shape[1])
    eps2 = (2 - 2 * cosine) / len(groups) + 1e-9
    inside = lambda dims, i, j: ((pa_[i][:, dims] - pb[j][:, dims]) ** 2).sum(1) <= eps2

    def ordered(p: np.ndarray, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(np.floor(p[:, dims] / np.sqrt(eps2))[:, ::-1].T)
        return order, p[order][:, dims]

    def leaves(x: np.ndarray) -> np.ndarray:
        whole = np.full((-(-len(x) // LEAF) * LEAF, x.shape[1]), 1e3)  # what fills the last leaf is far from all
        whole[: len(x)] = x
        return whole.reshape(-1, LEAF, x.shape[1])

    for g, dims in enumerate(groups):
        one, x = ordered(pa_, dims)
        two, y = (one, x) if same else ordered(pb, dims)
        xs, ys = leaves(x), leaves(y)
        xn, yn = (xs * xs).sum(2), (ys * ys).sum(2)
        yn = np.where(yn > 1e5, np.inf, yn)
        la, lb = near_leaves(x, y, eps2 + 1e-9, same)
        if compared is not None:
            compared.append(len(la) * LEAF * LEAF)
        for lo in range(0, len(la), 128):
            p, q = la[lo : lo + 128], lb[lo : lo + 128]
            far = xn[p][:, :, None] + yn[q][:, None, :] - 2 * (xs[p] @ ys[q].transpose(0, 2, 1))
            n, s, t = np.nonzero(far <= eps2 + 1e-9)
            s, t = p[n] * LEAF + s, q[n] * LEAF + t
            real = (s < len(a)) & ((s < t) if same else True)
            i, j = one[s[real]], two[t[real]]
            if same:
                i, j = np.minimum(i, j), np.maximum(i, j)
            for k in range(0, len(i), 1 << 16):
                u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                good = np.einsum("ij,ij->i", a[u], b[v]) >= cosine
                u, v = u[good], v[good]
                mine = inside(dims, u, v)  # a pair belongs to the first group in which it is near
                for before in groups[:g]:
                    mine &= ~inside(before, u, v)
                if mine.any():
                    yield u[mine], v[mine]


class Links:
    """Numbers of links and stars of the pairs of two blocks, in memory bounded by the blocks."""

    def __init__(self, size: int):
        self.size, self.links = size, np.zeros(size, np.int64)
        self.i, self.j, self.waiting = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray, weights: np.ndarray) -> None:
        self.links += np.bincount(i, weights[j], self.size).astype(np.int64) + np.bincount(j, weights[i], self.size).astype(np.int64)
        self.i.append(i)
        self.j.append(j)
        self.waiting += len(i)
        if self.waiting > 1 << 20:
            self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        child, root = stars(np.concatenate([none, *self.i]), np.concatenate([none, *self.j]), self.size)
        self.i, self.j, self.waiting = [child], [root], 0
        return child, root


FOUND = "src long, dst long, rep long, links long"


def _found(met: Links, reps: np.ndarray) -> pa.RecordBatch:
    child, root = met.stars()
    some = met.links > 0
    src, dst, n = reps[child], reps[root], int(some.sum())
    none, rest = pa.nulls(n, pa.int64()), pa.nulls(len(src), pa.int64())
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in ([none, pa.array(src)], [none, pa.array(dst)], [pa.array(reps[some]), rest], [pa.array(met.links[some]), rest])], ["src", "dst", "rep", "links"])


def _blocks(classes: DataFrame, directions: np.ndarray, dim: int, eps: float, rows: int) -> DataFrame:
    """The epsilon grid order of (raw, rep, n) in blocks of ``rows``: bounding box, and all members in binary columns."""
    sent = classes.sparkSession.sparkContext.broadcast(directions[:, :LEAD])
    order = [f"c{i}" for i in range(min(ORDERED, dim))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(_matrix(batch.column("raw"), dim) @ sent.value[:, : len(order)] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], [*batch.schema.names, *order])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def made(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = _matrix(part.column("raw").combine_chunks(), dim)
            p = x @ sent.value
            cols = [pa.array([number]), pa.array([p.min(0)], pa.list_(pa.float64())), pa.array([p.max(0)], pa.list_(pa.float64()))]
            cols += [pa.array([part.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("rep", "n")]
            number += 1
            return pa.RecordBatch.from_arrays([*cols, pa.array([x.astype("<f8").tobytes()], pa.binary())], ["block", "lo", "hi", "reps", "ns", "vectors"])

        for batch in batches:
            waiting.append(batch.select(["raw", "rep", "n"]))
            size += batch.num_rows
            while size >= rows:
                whole = pa.Table.from_batches(waiting)
                yield made(whole.slice(0, rows))
                waiting, size = whole.slice(rows).to_batches(), size - rows
        if size:
            yield made(pa.Table.from_batches(waiting))

    projected = classes.mapInArrow(project, T.StructType([*classes.schema.fields, *(T.StructField(c, T.IntegerType()) for c in order)]))
    parts = max(1, -(-classes.count() // rows))
    return projected.repartitionByRange(parts, *order, "rep").sortWithinPartitions(*order, "rep").mapInArrow(cut, "block long, lo array<double>, hi array<double>, reps binary, ns binary, vectors binary")


def _joined(classes: DataFrame, dim: int, cosine: float, rows: int) -> DataFrame:
    """Links (src, dst) and numbers of links (rep, links) between the classes (raw, rep, n) of one length."""
    eps = max(float(np.sqrt(2 - 2 * cosine)), 1e-6)
    directions = principal_dimensions(classes, dim)
    sent = classes.sparkSession.sparkContext.broadcast(directions)
    blocks = saved(_blocks(classes, directions, dim, eps, rows))
    # Pairs of blocks: by shared cells of the boxes on the first dimensions, then by the boxes' distance.
    cells = lambda at, wide: F.sequence(F.floor(F.get("lo", F.lit(at)) / eps) - wide, F.floor(F.get("hi", F.lit(at)) / eps) + wide)
    box = blocks.select("block", "lo", "hi")

    def side(wide: int, name: str) -> DataFrame:
        first = box.select("*", F.explode(cells(0, wide)).alias("x"))
        return first.select(F.struct("block", "lo", "hi").alias(name), "x", F.explode(cells(1, wide)).alias("y") if dim > 1 else F.lit(0).alias("y"))

    gap = F.zip_with(F.zip_with("a.lo", "b.hi", lambda p, q: p - q), F.zip_with("b.lo", "a.hi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    pairs = side(0, "a").join(side(1, "b"), ["x", "y"]).where(F.col("a.block") <= F.col("b.block")).where(apart <= eps * eps + 1e-9).select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()
    of = lambda name: blocks.select(F.col("block").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("reps", "ns", "vectors")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: E731, B023
                same = get("a") == get("b")
                x, y = (np.frombuffer(get(f"{s}_vectors"), "<f8").reshape(-1, dim) for s in "ab")
                xr, yr, xn, yn = (np.frombuffer(get(f"{s}_{c}"), "<i8") for c in ("reps", "ns") for s in "ab")
                met, move = Links(len(x) if same else len(x) + len(y)), 0 if same else len(x)
                for i, j in ego_pairs(x, y, x @ sent.value, y @ sent.value, cosine, same):
                    met.add(i, j + move, xn if same else np.concatenate([xn, yn]))
                yield _found(met, xr if same else np.concatenate([xr, yr]))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, FOUND)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """(key, n_links long, component_id long, kept boolean) for each row.

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine``; a row's component is
    the smallest key that links reach. Vectors that are null, empty, zero, hold null or non-finite components or have a
    null key link with nothing; those of different lengths don't link with each other. Repeated rows are rows of their
    own and link. Keys must be whole numbers. Other columns are not read; an empty table gives an empty result.
    ``block`` sets the vectors of a block instead of a share of all.
    """
    if cosine <= -1:
        raise ValueError("cosine must be above -1")
    vectors = saved(valid_vectors(df, key, vector))
    classes = saved(vectors.groupBy("raw").agg(F.min(F.col(key).cast("long")).alias("rep"), F.count("*").alias("n")).select("raw", "rep", "n", (F.octet_length("raw") / 8).cast("int").alias("dim")))
    # Lengths with many vectors, each of at least ``SMALL`` numbers, so their list is short beside the data.
    crowded = [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("dim") * F.col("n") > SMALL).collect()]

    def together(part: pa.Table) -> pa.Table:
        x = _matrix(part.column("raw").combine_chunks(), part.column("dim")[0].as_py())
        met, n = Links(len(x)), part.column("n").to_numpy()
        for i, j in ego_pairs(x, x, x, x, cosine, True):
            met.add(i, j, n)
        return pa.Table.from_batches([_found(met, part.column("rep").to_numpy())])

    few = classes.where(~F.col("dim").isin([d for d, _ in crowded])) if crowded else classes
    found = few.groupBy("dim").applyInArrow(together, FOUND)
    for dim, n in crowded:
        rows = block or int(min(max(n // SHARE + 1, LEAST_BYTES // (8 * dim)), max(1, MOST_BYTES // (8 * dim))))
        found = found.unionByName(_joined(classes.where(F.col("dim") == dim).select("raw", "rep", "n"), dim, cosine, rows))
    found = saved(found)
    roots = components(found.select("src", "dst")).select(F.col("node").alias("rep"), "root")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    reached = roots.join(least, "root").select("rep", "component_id")
    counted = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "rep", "left").join(reached, "rep", "left").select("raw", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = vectors.join(known, "raw").select(key, "n_links", "component_id")
    # Rows that cannot link, repeated ones included, keep to themselves.
    alone = df.where(F.col(key).isNull() | ~_usable(vector)).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _usable(vector: str):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))
