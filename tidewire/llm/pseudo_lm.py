"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

All words of the corpus are counted in a keyed table. The ``COMMON`` most frequent ones have token ids of their own, by
falling frequency; the others share ``RARE`` ids by hash. The two words before and the two after a token (the token
itself masked) are embedded, by side, and summed. Three softmaxes predict the id digit by digit (64 x 32 x 32), with
biases for the digits before, so that a prediction costs 128 outputs; the biases begin as the corpus' log counts.

Documents are dealt into shards of about ``SHARD`` tokens by a hash of key and text, each into one of ``ROUNDS`` rounds.
In a round every shard trains on its documents in hash order, starting from the last round's parameters; a Spark
aggregation then averages each row of parameters over the shards by its occurrences there. So what is learnt depends on
the corpus only, not on its files, partitions or the cluster.

A rare id is a class of words: a word's probability is its class's probability in the context times the word's share of
the class, from the keyed counts, which grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import textnum as N
from tidewire.llm.common import byte_slices, stored, text_buffer

DIGITS = (64, 32, 32)
#: One id is left over: it stands for the place beyond a text's end.
OUTSIDE = 64 * 32 * 32 - 1
RARE = 4096
COMMON = OUTSIDE - RARE
WIDTH, REACH = 8, 2
STEP = 0.15
BATCH = 8192
ROUNDS = 3
#: Tokens of a shard over all rounds, about.
SHARD = 4_000_000
SHAPES = {"left": (OUTSIDE + 1, WIDTH), "right": (OUTSIDE + 1, WIDTH), "out0": (WIDTH, 64), "out1": (WIDTH, 32), "out2": (WIDTH, 32), "bias0": (1, 64), "bias1": (64, 32), "bias2": (64 * 32, 32)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


@dataclass
class Model:
    #: Hashes of the common words; a word's place is its id.
    common: np.ndarray
    flat: np.ndarray


def parameters(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    return out


def started(counts: np.ndarray | None = None) -> np.ndarray:
    """The parameters before training: random embeddings, and biases from the ids' counts."""
    rng = np.random.default_rng(17)
    flat = np.concatenate([rng.normal(0, 0.3, s).ravel() if not k.startswith("bias") else np.zeros(int(np.prod(s))) for k, s in SHAPES.items()]).astype(np.float32)
    if counts is not None:
        n, p = np.append(counts, 0).reshape(DIGITS).astype(float), parameters(flat)
        p["bias0"][:], p["bias1"][:], p["bias2"][:] = np.log1p(n.sum((1, 2))), np.log1p(n.sum(2)), np.log1p(n).reshape(-1, 32)
    return flat


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all rows' words and the rows' bounds; words are lower-cased (A-Z)."""
    starts, ends, rows = N.words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    return N.span_hashes(N.LOWER[data], starts, ends), rows


class Ids:
    """Token ids of word hashes: a table by the hashes' low bits, and a sorted list of the words that found no place."""

    def __init__(self, common: np.ndarray, bits: int = 20):
        self.mask, numbers = np.uint64((1 << bits) - 1), np.arange(len(common))
        self.words, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        slots = (common & self.mask).astype(np.int64)
        self.words[slots], self.places[slots] = common, numbers
        left = np.flatnonzero(self.places[slots] != numbers)
        self.place = left[np.argsort(common[left])]
        self.known = common[self.place]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes & self.mask).astype(np.int64)
        places = self.places[slots]
        ids = np.where((self.words[slots] == hashes) & (places >= 0), places, COMMON + (hashes % np.uint64(RARE)).astype(np.int64))
        if len(self.known):
            rest = np.flatnonzero(ids >= COMMON)
            at = np.minimum(np.searchsorted(self.known, hashes[rest]), len(self.known) - 1)
            hit = self.known[at] == hashes[rest]
            ids[rest[hit]] = self.place[at[hit]]
        return ids


def contexts(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ids before (nearest first) and after each token, one column a place; ``OUTSIDE`` where the row has none."""
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = np.full((len(ids), 2 * REACH), OUTSIDE, np.uint16)
    for d in range(1, REACH + 1):
        if len(ids) > d:
            same = row_of[d:] == row_of[:-d]
            out[d:, d - 1][same] = ids[:-d][same]
            out[:-d, REACH + d - 1][same] = ids[d:][same]
    return out


def _digits(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The three digits of each id, and the rows of their biases: the digits before."""
    return [ids >> 10, (ids >> 5) & 31, ids & 31], [np.zeros(len(ids), np.int64), ids >> 10, ids >> 5]


#: No output is taken for more than this, whose exponential is still a number.
MOST = 80


def _forward(p: dict, rows: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of the embeddings around, and the outputs of each digit before the softmax."""
    h = sum(p["left" if c < REACH else "right"][around[:, c]] for c in range(2 * REACH))
    outputs = []
    for k in range(3):
        z = h @ p[f"out{k}"]
        z += p["bias0"] if k == 0 else p[f"bias{k}"][rows[k]]
        outputs.append(np.minimum(z, MOST, out=z))
    return h, outputs


def log_probabilities(p: dict, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of each token's probability given both its sides."""
    around, out = contexts(ids, rows), np.zeros(len(ids))
    for lo in range(0, len(ids), BATCH):
        part = ids[lo : lo + BATCH]
        at, (digits, biases) = np.arange(len(part)), _digits(part)
        _, outputs = _forward(p, biases, around[lo : lo + BATCH])
        for z, q in zip(outputs, digits):
            said = z[at, q].astype(float)
            out[lo : lo + BATCH] += said - np.log(np.maximum(np.exp(z, out=z).sum(1), 1e-30).astype(float))
    return out


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``at`` and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def gradients(p: dict, ids: np.ndarray, around: np.ndarray) -> dict[str, tuple]:
    """For each table the rows (a slice for all) in which the batch's mean loss has a gradient, and that gradient."""
    n, at = len(ids), np.arange(len(ids))
    digits, biases = _digits(ids)
    h, outputs = _forward(p, biases, around)
    out, dh = {}, np.zeros_like(h)
    for k, (s, q) in enumerate(zip(outputs, digits)):
        np.exp(s, out=s)
        s *= 1 / (n * np.maximum(s.sum(1, keepdims=True), 1e-30))
        s[at, q] -= s.dtype.type(1 / n)
        dh += s @ p[f"out{k}"].T
        out[f"out{k}"] = (slice(None), h.T @ s)
        out[f"bias{k}"] = (slice(None), s.sum(0, keepdims=True)) if k == 0 else _summed(biases[k].astype(np.uint16), s)
    twice = np.concatenate([dh] * REACH)
    out["left"] = _summed(around[:, :REACH].T.ravel(), twice)
    out["right"] = _summed(around[:, REACH:].T.ravel(), twice)
    return out


def train_step(p: dict, seen: dict, ids: np.ndarray, around: np.ndarray) -> None:
    """One AdaGrad step on the mean loss of a batch."""
    for k, (rows, grad) in gradients(p, ids, around).items():
        seen[k][rows] += grad * grad
        p[k][rows] -= STEP * grad / (np.sqrt(seen[k][rows]) + 1e-8)


class Shard:
    """One shard's training in one round."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p = parameters(self.flat)
        self.seen = parameters(np.zeros(SIZE, np.float32))
        self.met = {k: np.zeros(s[0], np.int64) for k, s in SHAPES.items()}
        self.ids, self.around, self.n = [], [], 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Steps of exactly ``BATCH`` tokens, however the rows come in."""
        self.ids.append(ids)
        self.around.append(contexts(ids, rows))
        self.n += len(ids)
        if self.n >= BATCH:
            self._step(BATCH)

    def _step(self, least: int) -> None:
        ids, around, lo = np.concatenate(self.ids), np.concatenate(self.around), 0
        while len(ids) - lo >= least and lo < len(ids):
            part, near = ids[lo : lo + BATCH], around[lo : lo + BATCH]
            train_step(self.p, self.seen, part, near)
            for k in range(3):
                self.met[f"out{k}"] += len(part)
                self.met[f"bias{k}"] += np.bincount(_digits(part)[1][k], minlength=SHAPES[f"bias{k}"][0])
            self.met["left"] += np.bincount(near[:, :REACH].ravel(), minlength=OUTSIDE + 1)
            self.met["right"] += np.bincount(near[:, REACH:].ravel(), minlength=OUTSIDE + 1)
            lo += len(part)
        self.ids, self.around, self.n = [ids[lo:]], [around[lo:]], len(ids) - lo

    def result(self) -> pa.RecordBatch:
        """(at, n, v0 .. v7): the parameters in eights that the shard's tokens met, and how often."""
        self._step(1)
        n = np.concatenate([np.repeat(self.met[k], s[1] // 8) for k, s in SHAPES.items()])
        at = np.flatnonzero(n)
        values = self.flat.reshape(-1, 8)[at]
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], ["at", "n", *(f"v{i}" for i in range(8))])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word long: its hash, n long) of every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0

        def merged() -> pa.RecordBatch:
            known, which = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(which, np.concatenate(counts), len(known)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for part in byte_slices(batch, text):
                known, n = np.unique(word_hashes(*text_buffer(part.column(text)))[0], return_counts=True)
                words.append(known)
                counts.append(n)
                size += len(known)
                if size > 1 << 20:  # a bounded table of the task; Spark sums over all tasks
                    yield merged()
                    words, counts, size = [], [], 0
        if size:
            yield merged()

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> Model:
    """Parameters learnt from every word of every text; the same for any partitioning of ``docs``.

    The driver gets the common words and ``ROUNDS`` times one set of ``SIZE`` numbers, whatever the input's size; the
    counts of all words, and what the shards learnt of them, stay in Spark and grow with the input. Rows that repeat
    key and text are trained on in one shard.
    """
    counts = stored(word_counts(docs, text)) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    common = top.column("word").to_numpy().view(np.uint64)
    ids = Ids(common)
    per_id = np.zeros(OUTSIDE, np.int64)
    per_id[: len(common)] = top.column("n").to_numpy()
    total = counts.agg(F.sum("n")).first()[0] or 0
    rest = counts.groupBy(F.pmod("word", F.lit(RARE)).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # ``RARE`` rows
    of_rest = np.zeros(RARE, np.int64)
    of_rest[rest.column("id").to_numpy().astype(int)] = rest.column("n").to_numpy()
    per_id[COMMON:] = of_rest - np.bincount((common % np.uint64(RARE)).astype(int), per_id[: len(common)], RARE).astype(np.int64)
    flat = started(per_id)
    shards = max(8, -(-total // SHARD))
    spread = docs.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t")).withColumn("slot", F.pmod("h", F.lit(shards * ROUNDS)))
    context = docs.sparkSession.sparkContext
    sent_ids = context.broadcast(common)
    schema = "at int, n long, " + ", ".join(f"v{i} float" for i in range(8))
    for number in range(ROUNDS if total else 0):
        sent = context.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, slot, shard = Ids(sent_ids.value), None, None
            for batch in batches:
                slots = batch.column("slot").to_numpy()
                edges = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
                for lo, hi in zip(edges, edges[1:]):
                    if lo < hi and slots[lo] != slot:
                        if shard:
                            yield shard.result()
                        slot, shard = slots[lo], Shard(sent.value)
                    for part in byte_slices(batch.slice(lo, hi - lo), "t"):
                        hashes, rows = word_hashes(*text_buffer(part.column("t")))
                        shard.add(ids(hashes), rows)
            if shard:
                yield shard.result()

        dealt = spread.where(F.col("slot") % ROUNDS == number).repartition(shards, "slot").sortWithinPartitions("slot", "h").select("slot", "t")
        sums = [F.sum(F.col(f"v{i}").cast("double") * F.col("n")).alias(f"v{i}") for i in range(8)]
        got = dealt.mapInArrow(run, schema).groupBy("at").agg(F.sum("n").alias("n"), *sums).toArrow()
        flat = flat.copy()
        values = np.column_stack([got.column(f"v{i}").to_numpy() for i in range(8)]) if got.num_rows else np.zeros((0, 8))
        flat.reshape(-1, 8)[got.column("at").to_numpy()] = values / got.column("n").to_numpy()[:, None]
        sent.unpersist()
    return Model(common, flat)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", words: bool = False) -> DataFrame:
    """(key, n_tokens long, log_likelihood double, score double) of each whole text's ids under the trained parameters.

    The score is the mean over the tokens. A null or blank text has no tokens, a log-likelihood of 0 and a null score.
    Repeated rows are scored each. With ``words`` a column words array<struct<word long, n int>> is added: the hashes
    of the row's rare words and their counts.
    """
    context = docs.sparkSession.sparkContext
    sent, sent_ids = context.broadcast(model.flat.astype(np.float32)), context.broadcast(model.common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, id_of = parameters(sent.value), Ids(sent_ids.value)
        for batch in batches:
            for part in byte_slices(batch, text):
                hashes, rows = word_hashes(*text_buffer(part.column(text)))
                ids = id_of(hashes)
                total, n = N.row_sums(log_probabilities(p, ids, rows), rows), np.diff(rows)
                out = [part.column(key), pa.array(n.astype(np.int64)), pa.array(total), pa.array(total / np.maximum(1, n), mask=n == 0)]
                if words:
                    rare = ids >= COMMON
                    out.append(row_words(hashes[rare], np.concatenate(([0], np.cumsum(rare)))[rows]))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("score", T.DoubleType())])
    if words:
        schema = schema.add("words", T._parse_datatype_string("array<struct<word: bigint, n: int>>"))
    return docs.select(key, text).mapInArrow(run, schema)


def row_words(hashes: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Each row's different word hashes with their counts."""
    known, which = np.unique(hashes, return_inverse=True)
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs, counts = np.unique(row_of * max(1, len(known)) + which, return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(len(rows)) * max(1, len(known)))
    held = known[pairs % max(1, len(known))] if len(known) else known
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(held.view(np.int64)), pa.array(counts.astype(np.int32))], ["word", "n"]))


def word_shares(counts: DataFrame, common: np.ndarray) -> DataFrame:
    """(word, share double): the natural log of each rare word's share of its id's occurrences."""
    spark = counts.sparkSession
    top = spark.createDataFrame(pa.table({"word": common.view(np.int64)}))  # at most ``COMMON`` rows
    rare = counts.join(F.broadcast(top), "word", "left_anti").withColumn("id", F.pmod("word", F.lit(RARE)))
    of_id = rare.groupBy("id").agg(F.sum("n").alias("all"))  # at most ``RARE`` rows
    return stored(rare.join(F.broadcast(of_id), "id").select("word", F.ln(F.col("n") / F.col("all")).alias("share")))


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on ``docs`` and score them: the columns of ``score``, with the probabilities of words instead of their ids.

    A row with a null key is trained on and scored like others. An empty table gives an empty result.
    """
    counts = stored(word_counts(docs, text))
    model = train(docs, key, text, counts)
    scored = stored(score(docs, model, key, text, words=True).withColumn("_row", F.monotonically_increasing_id()))
    words = scored.select("_row", F.explode("words").alias("w")).select("_row", "w.word", "w.n")
    shares = words.join(word_shares(counts, model.common), "word").groupBy("_row").agg(F.sum(F.col("n") * F.col("share")).alias("_share"))
    total = F.col("log_likelihood") + F.coalesce("_share", F.lit(0.0))
    return scored.drop("words").join(shares, "_row", "left").select(key, "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("score"))
