"""Divergence of the sources of each language from one another and from the language, over its common terms.

1. Arrow batches count terms of each (lang, source); Spark sums them, and keeps a language's terms that occur in enough of
   its documents.
2. Terms are dealt into blocks by hash, sources too. A tile is one block of terms under one pair of blocks of sources: its
   task makes a dense numpy int64 matrix, groups by terms, and compares all its groups by broadcasting.
3. Spark sums the tiles' partial pair matrices; each tile also gives the largest terms of every group (a heap of ``top``
   for each), and a ranking window, which Spark limits before it shuffles, merges the heaps.

A tile has ``GROUPS`` groups a side and ``TERMS`` terms on average, so its size doesn't grow with the data; hot languages,
sources and terms only mean more tiles or larger numbers. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import byte_slices, stored, text_buffer
from tidewire.llm.textnum import LOWER, runs

#: Letters of ASCII and every byte of a character beyond it.
TERM = np.zeros(256, np.uint8)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Terms and groups that a tile holds on average (a side, for groups).
TERMS, GROUPS = 256, 256
SCALE_STEPS = (1000, 1000, 1000)


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n: occurrences, docs: documents that hold it), summed over all rows; null texts have none.

    Terms are maximal runs of ASCII letters and characters beyond ASCII; only A to Z are lower-cased.
    """

    by = ("lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text, 4 << 20):
                data, offsets = text_buffer(part.column(text))
                starts, ends, bounds = runs(TERM[data], offsets)
                if len(starts) == 0:
                    continue
                lengths = ends - starts
                at = np.concatenate([[0], np.cumsum(lengths)])
                low = LOWER[data[TERM[data] > 0]]  # terms side by side, in order
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(low)).dictionary_encode()
                code = words.indices.to_numpy().astype(np.int64)
                groups = list(zip(*(part.column(c).to_pylist() for c in by)))
                known = {g: i for i, g in enumerate(dict.fromkeys(groups))}
                row_group = np.array([known[g] for g in groups], np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                vocabulary = len(words.dictionary)
                in_row = np.unique(row * vocabulary + code)
                docs_of = row_group[in_row // vocabulary] * vocabulary + in_row % vocabulary
                keys, n = np.unique(row_group[row] * vocabulary + code, return_counts=True)
                _, docs = np.unique(docs_of, return_counts=True)  # the same keys
                names = list(known)
                columns = [pa.array([g[k] for g in names], pa.string()).take(pa.array(keys // vocabulary)) for k in range(len(by))]
                term = words.dictionary.cast(pa.string()).take(pa.array(keys % vocabulary))
                yield pa.RecordBatch.from_arrays([*columns, term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    filled = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by)
    counted = df.select(*filled, text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) exactly, by long division; ``total`` below 9 * 10^15."""
    quotient, rest = np.zeros_like(count), count
    for step in SCALE_STEPS:
        digit, rest = np.divmod(rest * step, total)
        quotient = quotient * step + digit
    return 1 + quotient


def divergences(df: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value long, rank int) of every (lang, source) of ``df``.

    Part ``pair``: the item is another source of the language, the value the summed differences of both sources' scaled
    frequencies over all kept terms. Part ``term``: a kept term that the source uses more than its language, the value
    the difference, for the ``top`` largest. Ranks are by value descending, then by the item's bytes. Null text, lang and
    source count as ''. A language without kept terms has pairs of value 0 and no terms, one with a single source no
    pairs; an empty table gives no rows; repeated rows count each. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col(text).alias("text"))
    counts = stored(term_counts(rows))
    common = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = stored(counts.drop("docs").join(common, ["lang", "term"]))
    # What a tile must know of languages and groups, also those without terms.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    terms = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("of_lang").alias("lang_N"))
    groups = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources")).join(terms, "lang", "left").na.fill(0, ["V", "lang_N"])
    langs = langs.select("lang", "V", "lang_N", F.ceil(F.greatest("V", F.lit(1)) / TERMS).cast("int").alias("term_blocks"), F.ceil(F.col("_sources") / GROUPS).cast("int").alias("source_blocks"))
    langs = stored(langs)
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["N"]).join(langs, "lang")

    def tiled(rows: DataFrame) -> DataFrame:
        """Each row under every pair (a <= b) of blocks of sources that holds its source's."""
        own = F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int")
        rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)))
        return rows.withColumn("a", F.least("_own", "_other")).withColumn("b", F.greatest("_own", "_other")).drop("_own", "_other")

    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")
    cells = tiled(kept.join(langs.select("lang", "term_blocks", "source_blocks"), "lang").withColumn("t", term_block))
    heads = tiled(groups.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))))
    key = ["lang", "t", "a", "b"]

    def tile(cells: pa.Table, heads: pa.Table) -> pa.Table:
        source = heads.column("source").combine_chunks()
        G = len(source)
        if G == 0:
            return OUT.empty_table()
        term = cells.column("term").combine_chunks().dictionary_encode()
        code, vocabulary = term.indices.to_numpy().astype(np.int64), len(term.dictionary)
        count = np.zeros((G, vocabulary), np.int64)
        at = pc.index_in(cells.column("source").combine_chunks(), source).to_numpy()
        count[at, code] = cells.column("n").to_numpy()
        number = lambda name: heads.column(name).to_numpy()
        V = int(number("V")[0])
        p = scaled(count + smooth, (number("N") + smooth * V)[:, None]) if vocabulary else count
        held = pa.table({"lang": heads.column("lang"), "source": heads.column("source")})
        out = []
        i = int(heads.column("a")[0].as_py()), int(heads.column("b")[0].as_py())
        block = heads.column("block").to_numpy()
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == i[1])
        total = np.zeros((len(left), len(right)), np.int64)
        wide = max(1, (1 << 22) // max(1, len(left) * len(right)))
        for lo in range(0, vocabulary, wide):  # all pairs at once, a few terms at a time
            total += np.abs(p[left, None, lo : lo + wide] - p[None, right, lo : lo + wide]).sum(axis=2)
        for ours, theirs, sum_ in ((left, right, total), (right, left, total.T))[: 1 + (i[0] != i[1])]:
            one, two = np.repeat(np.arange(len(ours)), len(theirs)), np.tile(np.arange(len(theirs)), len(ours))
            differ = ours[one] != theirs[two]
            one, two = one[differ], two[differ]
            mine = held.take(pa.array(ours[one]))
            out.append(pa.table([*mine.columns, pa.array(["pair"] * len(one), pa.string()), source.take(pa.array(theirs[two])), pa.array(sum_[one, two])], schema=OUT))
        if i[0] == i[1] and vocabulary:
            of_lang = np.zeros(vocabulary, np.int64)
            of_lang[code] = cells.column("of_lang").to_numpy()
            over = p - scaled(of_lang + smooth, np.full(vocabulary, int(number("lang_N")[0]) + smooth * V, np.int64))
            over[count == 0] = 0
            names = term.dictionary.cast(pa.binary()).to_pylist()
            rank = np.empty(vocabulary, np.int64)  # of the terms by their bytes
            rank[sorted(range(vocabulary), key=names.__getitem__)] = np.arange(vocabulary)
            for g in range(G):
                heap = np.lexsort((rank, -over[g]))[:top]
                heap = heap[over[g][heap] > 0]
                mine = held.take(pa.array(np.full(len(heap), g)))
                out.append(pa.table([*mine.columns, pa.array(["term"] * len(heap), pa.string()), term.dictionary.take(pa.array(heap)), pa.array(over[g][heap])], schema=OUT))
        return pa.concat_tables(out)

    heads = heads.withColumn("block", F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int")).drop("source_blocks", "term_blocks")
    cells = cells.select(*key, "source", "term", "n", "of_lang")
    parts = cells.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(tile, "lang string, source string, part string, item string, value long")
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = summed.withColumn("rank", F.row_number().over(best))
    heaps = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)


OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
