"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near-duplicates if one word inserted, deleted or replaced turns one into the other (words lower-cased).
Equal lines form a class. A line of at least ``MIN_WORDS`` words emits as hashed keys its variants with one word deleted
(a gap at that place) and, as the other side of an insertion, itself with a gap at each place; equal variants join, and
the join is verified on the words. A line goes if an equal or near-duplicate line stands earlier (by key, then line).

Before variants are emitted, lines that cannot have a near-duplicate are set aside without loss: one edit leaves the
first or the last half of the words unchanged, so a line whose halves occur in no other line has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import may_match, stored

#: With fewer words one edit would go below a similarity of 0.8; shorter lines are only compared for equality.
MIN_WORDS = 5


#: What \s stands for, but for the line break.
SPACE = " \t\x0b\f\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def line_words(line: Column) -> Column:
    return F.split(trimmed(F.lower(line)), r"\s+")


def _variants(lines: DataFrame) -> DataFrame:
    """(variant, line, at, deleted) of lines (line: hash, words): a gap at place ``at``, one word deleted there or not.

    The key hashes the number of words left, the gap's place and the words left in any order (an XOR), so a line's
    variants cost one step each; whoever shares a key is compared by the words in order afterwards.
    """
    hashed = lines.select("line", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    summed = hashed.select("line", "hs", F.size("hs").alias("n"), F.aggregate("hs", F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h)).alias("all"))
    key = lambda size, at, left: F.xxhash64(size.cast("int"), at.cast("int"), left)
    gone = F.transform("hs", lambda h, i: F.struct(key(F.col("n") - 1, i, F.col("all").bitwiseXOR(h)).alias("variant"), i.alias("at"), F.lit(True).alias("deleted")))
    gaps = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.struct(key(F.col("n"), i, F.col("all")).alias("variant"), i.alias("at"), F.lit(False).alias("deleted")))
    return summed.select("line", F.explode(F.concat(gone, gaps)).alias("v")).select("v.variant", "line", "v.at", "v.deleted")


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(line: hash of the words, first: struct of key and line_no, n: words, near: boolean) of each different line
    that is not blank; near: a near-duplicate of an earlier line."""
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("raws")).where("raws is not null")
    lines = texts.select("key", "text_hash", F.posexplode("raws").alias("line_no", "raw")).where(trimmed(F.col("raw")) != "")
    split = lines.select("key", "text_hash", "line_no", line_words(F.col("raw")).alias("words"))
    n = F.size("words")
    half = lambda q, side: F.when(n >= MIN_WORDS, F.xxhash64(F.lit(side), F.slice("words", F.lit(1) if side == "p" else n - q + 1, q)))
    q1, q2 = (n / 2).cast("int"), ((n - 1) / 2).cast("int")
    hashed = split.select("key", "text_hash", "line_no", F.xxhash64("words").alias("line"), n.alias("n"), half(q1, "p").alias("k0"), half(q1, "s").alias("k1"), F.when(q1 != q2, half(q2, "p")).alias("k2"), F.when(q1 != q2, half(q2, "s")).alias("k3"))
    ks = [f"k{i}" for i in range(4)]
    classes = stored(hashed.groupBy("line").agg(F.min(F.struct("key", "line_no", "text_hash")).alias("first"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in ks]))
    halves = classes.where(F.col("n") >= MIN_WORDS).select("line", F.explode(F.array_compact(F.array(*ks))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a != b").select("half")
    suspects = stored(classes.join(halves.join(shared, "half", "left_semi").select("line").distinct(), "line", "left_semi").select("line", "first"))
    # The suspects' words, from their first rows: others are left out by the bit map of places before their words are split.
    place = F.xxhash64("key", "text_hash", "line_no").alias("place")
    passed = may_match(lines.select(place, "raw"), F.col("place"), suspects.select(F.xxhash64("first.key", "first.text_hash", "first.line_no").alias("place")))
    said = passed.select(F.xxhash64(line_words(F.col("raw"))).alias("line"), "raw")
    suspects = stored(suspects.join(said.groupBy("line").agg(F.min("raw").alias("raw")), "line").select("line", "first", line_words(F.col("raw")).alias("words")))
    variants = _variants(suspects)
    shared = variants.groupBy("variant").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a != b").select("variant")
    met = variants.join(shared, "variant", "left_semi").select("line", "at", "deleted")
    without = lambda w, at, gone: F.when(gone, F.concat(F.slice(w, F.lit(1), at), F.slice(w, at + 2, F.size(w)))).otherwise(F.col(w))
    ordered = stored(met.join(suspects, "line").select("line", "first", "at", "deleted", F.xxhash64("at", without("words", F.col("at"), F.col("deleted"))).alias("same")))
    earliest = ordered.groupBy("same").agg(F.min(F.struct("first", "line", "deleted")).alias("e"))
    pairs = ordered.join(earliest, "same").where("line != e.line").groupBy("line", F.col("e.line").alias("other")).agg(F.min(F.struct("at", "deleted", F.col("e.deleted").alias("o_deleted"))).alias("p"))
    texts_of = lambda name, words: suspects.select(F.col("line").alias(name), F.col("words").alias(words))
    # Equal words around one gap: one edit turns one line into the other.
    verified = without("words", F.col("p.at"), F.col("p.deleted")) == without("o_words", F.col("p.at"), F.col("p.o_deleted"))
    near = pairs.join(texts_of("line", "words"), "line").join(texts_of("other", "o_words"), "other").where(verified).select("line").distinct().withColumn("near", F.lit(True))
    return classes.select("line", "first", "n").join(near, "line", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def _kept_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, kept): by key and hash of the text whether each line number stays, up to the last one that does."""
    first = line_classes(docs, key, text).where("not near").select("first.*")
    numbers = first.groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_list("line_no")).alias("stay"))
    # A flag for each line, from the gaps between the numbers: a look-up by place costs one step.
    gap = lambda n, i: F.when(i == 0, n).otherwise(n - F.get("stay", i - 1) - 1)
    flags = F.flatten(F.transform("stay", lambda n, i: F.concat(F.array_repeat(F.lit(False), gap(n, i)), F.array(F.lit(True)))))
    return numbers.select("k", "h", flags.alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each with its text cut to the lines that stay, and n_lines and n_kept (lines not blank).

    Of equal lines and of near-duplicates (see the module) the earliest stays; order is by key (null first), then by
    line, then by a hash of the text. Blank lines stay and are not counted. A null text stays null. Rows that repeat
    key and text get one verdict. Columns of ``docs`` other than key and text pass through whatever their names, but
    for n_lines and n_kept, which the new ones replace.
    """
    kept = _kept_lines(docs, key, text)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    said = F.col("row").getField(text)
    held = row.join(kept, F.col("row").getField(key).eqNullSafe(F.col("k")) & (F.xxhash64(said) == F.col("h")), "left")
    lines = F.split(F.coalesce(said, F.lit("")), "\n", -1)
    blank = lambda x: trimmed(x) == ""
    stay = F.filter(lines, lambda x, i: blank(x) | F.coalesce(F.get("kept", i), F.lit(False)))
    cut = held.select("row", stay.alias("stay"), F.size(F.filter(lines, lambda x: ~blank(x))).cast("long").alias("n_lines"))
    count = F.size(F.filter("stay", lambda x: ~blank(x))).cast("long")
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "n_lines", "n_kept")]
    return cut.select(*others, F.when(said.isNotNull(), F.array_join("stay", "\n")).alias(text), "n_lines", count.alias("n_kept"))
