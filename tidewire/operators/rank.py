"""Dedupe, top-k and diversity over items and stories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions.items import is_mergeable
from tidewire.operators.similar import story_similarity


def first_by(df: DataFrame, keys: list, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order; Spark's group limit cuts each key on the map side first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the least in the order struct; partial aggregation copes with keys that have very many rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def penalised(stories: DataFrame, limit: int, penalty: float = 0.03) -> DataFrame:
    """The first ``limit`` stories with a penalty for each earlier one of the same source.

    Picking greedily is the same as ranking by score less penalty times the story's rank in its source. A source's
    stories past ``limit`` can't be picked, so each is cut before the global order.
    """
    cut = stories.withColumn("source_pick", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "title", "story_id"))).where(F.col("source_pick") <= limit)
    return cut.withColumn("adjusted", F.col("score") - (F.col("source_pick") - 1) * penalty).orderBy(F.desc("adjusted"), F.desc("score"), "title", "story_id").limit(limit)


def diverse(stories: DataFrame, limit: int, penalty: float = 0.03, threshold: float = 0.86, jaccard: float = 0.4) -> DataFrame:
    """(story_id, place): the first ``limit`` stories (story_id, source, title, score) picked greedily with a penalty for
    each earlier pick of the same source, skipping titles that nearly repeat a picked one.

    ``title`` is normalised for stories; ties go by title, then story_id. The pick is replayed over a top set: the first
    of each source, and of these the first by score. It stands if no row outside could have been picked: none of a source
    that gave all its rows, and none with a score above a pick's value; else the set grows. Only the top set, a small
    multiple of ``limit`` unless titles repeat, meets in one task.
    """
    order = [F.desc("score"), F.col("title"), F.col("story_id")]
    deep, wide = 2 * limit, 8 * limit
    kind = stories.schema["story_id"].dataType.simpleString()
    title = F.col("title")
    while True:
        ranked = stories.select("story_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("score", F.lit(0.0)).alias("score"))
        ranked = first_by(ranked.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(*order))), ["source"], order, deep)
        top = ranked.orderBy(*order).limit(wide + 1).select("*", X.title_tokens(title).alias("tokens"), X.vendors(title).alias("vendors"), X.models(title).alias("models"), is_mergeable(title).alias("mergeable"))

        def pick(part: pd.DataFrame) -> pd.DataFrame:
            rows = part.sort_values(["score", "title", "story_id"], ascending=[False, True, True])
            beyond = rows.score.iloc[wide] if len(rows) > wide else float("-inf")
            left, picked, per_source, sure, number = list(rows.head(wide).itertuples()), [], {}, True, 0
            while left and len(picked) < limit:
                value = [r.score - penalty * per_source.get(r.source, 0) for r in left]
                best = max(range(len(left)), key=lambda i: (value[i], -i))
                sure = sure and value[best] >= beyond
                row = left.pop(best)
                if row.n == deep:  # what its source has behind isn't here
                    sure = False
                if row.mergeable and any(_repeats(row, p, threshold, jaccard) for p in picked):
                    continue
                per_source[row.source] = per_source.get(row.source, 0) + 1
                picked.append(row)
            sure = sure and (len(picked) == limit or beyond == float("-inf"))
            return pd.DataFrame([(p.story_id, i + 1, sure) for i, p in enumerate(picked)], columns=["story_id", "place", "sure"])

        got = top.groupBy(F.lit(0).alias("all")).applyInPandas(pick, f"story_id {kind}, place int, sure boolean").toArrow()  # at most ``limit`` rows
        if not got.num_rows or got.column("sure")[0].as_py():
            return stories.sparkSession.createDataFrame(got.select(["story_id", "place"]), f"story_id {kind}, place int")
        deep, wide = deep * 4, wide * 4


def _repeats(row, other, threshold: float, jaccard: float) -> bool:
    a, b = set(row.tokens), set(other.tokens)
    if not a or not b or len(a & b) < jaccard * len(a | b):
        return False
    if any(len(x) and len(y) and not set(x) & set(y) for x, y in ((row.vendors, other.vendors), (row.models, other.models))):
        return False
    return story_similarity(row.title, other.title, a, b, threshold) >= threshold


def votes(group: Column, *identity: Column) -> Column:
    """Distinct votes: sources of one ecosystem group count once, others each by their identity."""
    return F.count_distinct(F.coalesce(group, F.concat(F.lit("item:"), F.coalesce(*identity).cast("string"))))
