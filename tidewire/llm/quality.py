"""Document quality: hashed word n-gram logistic regression, learnt with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import textnum as N
from tidewire.llm.common import byte_slices, text_buffer

#: log2 of the number of hashed features.
FEATURE_BITS = 18
#: At most so many labelled rows of either class are learnt from (a documented bound, not tied to the input's size).
SAMPLE_PER_CLASS = 2500
#: Feature values are shares of a text's features, times this.
SCALE = 20.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sort of n-gram: the hashed feature numbers of all rows one after the other, and the rows' n + 1 bounds.

    Words are runs of letters and digits, or of other marks. Their lower-cased form gives 1- and 2-grams, their shape
    (kind, capitals, length) 1- and 3-grams.
    """
    starts, ends, rows = N.runs(N.KIND[data], offsets)
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))] * 4
    word = N.span_hashes(N.LOWER[data], starts, ends)
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(N.UPPER[data], out=capitals[1:])
    capitals = capitals[ends] - capitals[starts]
    size = ends - starts
    style = np.where(capitals == 0, 0, np.where(capitals == size, 2, np.where(N.UPPER[data[starts]], 1, 3)))
    shape = N.mixed((N.KIND[data[starts]].astype(np.uint64) * np.uint64(4) + style.astype(np.uint64)) * np.uint64(16) + np.minimum(size, 15).astype(np.uint64) + np.uint64(1))
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)
    out = []
    for salt, (hashes, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 3))):
        got = N.chained(hashes ^ np.uint64((salt + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)), n)
        number = (got[row_of[: len(got)] == row_of[n - 1 :]] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        out.append((number, np.concatenate(([0], np.cumsum(np.maximum(0, counts - n + 1))))))
    return out


def logits(model_weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sparse dot products of the rows' feature shares with the weights."""
    grams = features(data, offsets)
    total = sum(np.diff(bounds) for _, bounds in grams)
    return sum(N.row_sums(model_weights[number], bounds) for number, bounds in grams) / np.maximum(1, total) * SCALE + bias


def learn(rows: list[tuple[np.ndarray, np.ndarray, int, float]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """FTRL-proximal over sparse rows (feature numbers, values, label 0/1, weight); no rows give a score of 0.5."""
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y, importance = rows[r]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * importance
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return Model(w[:size], float(w[size]))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the key as text leaves 1 on division by 3. A null key: false."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from the labelled rows that are not held out, at most ``per_class`` of each class in hash order of the key.

    Rows without key or label are not learnt from; a key with several labels counts as its largest one; of texts with
    one key the first in order is taken. Only the sample's feature counts reach the driver.
    """
    known = labels.select(key, F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x per_class rows of two numbers
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(sample, key).groupBy(key, "y").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                grams = features(*text_buffer(part.column("text")))
                at, n = [], []
                for i in range(part.num_rows):
                    u, c = np.unique(np.concatenate([number[bounds[i] : bounds[i + 1]] for number, bounds in grams]), return_counts=True)
                    at.append(u.astype(np.int32))
                    n.append((c / max(1, c.sum())).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], [key, "y", "at", "share"])

    schema = T.StructType([docs.schema[key], T.StructField("y", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))])
    got = rows.select(key, "y", "text").mapInArrow(count, schema).toArrow().sort_by(key)
    seen = {y: got.column("y").to_pylist().count(y) for y in (0, 1)}
    learnt = []
    for y, at, share in zip(got.column("y").to_pylist(), got.column("at"), got.column("share")):
        importance = total[y] / seen[y] * sum(seen.values()) / sum(total.values())
        learnt.append((at.values.to_numpy(), share.values.to_numpy().astype(float) * SCALE, y, importance))
    return learn(learnt)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double in 0..1: likelihood of label 1) of each row's whole text.

    Null and blank texts have no features and get the bias alone. Repeated rows are scored each.
    """
    weights, bias = df.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                dot = logits(weights.value, bias, *text_buffer(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [key, "score"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``; see ``train`` and ``score`` for odd rows."""
    scored = score(docs, train(docs, labels, key, text), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and with all their columns, whose predicted label is 1. Scored in one pass, unshuffled."""
    model = train(docs, labels, key, text)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                dot = logits(weights.value, bias, *text_buffer(part.column(text)))
                yield part.filter(pa.array(dot >= 0))

    return docs.mapInArrow(run, docs.schema)
