"""Checkpoints and connected components for operators that settle in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names, else (on a local master only) a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidewire-checkpoint-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst of one type); nodes of one component share a root.

    In each round every node adopts the neighbour (or itself) that comes first in hash order, and the links are
    contracted onto the adopted nodes. Hash order makes a constant share of the nodes vanish in each round also on
    long chains, so the rounds grow with the logarithm of the largest component. Nothing but a row count reaches the
    driver. Links that hold null are ignored; an empty table gives an empty result.
    """
    edges = settled(links.select("src", "dst").where("src is not null and dst is not null and src != dst").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        parents = settled(both.groupBy(F.col("src").alias("node")).agg(F.min(rank("dst")).alias("m")).select("node", F.least(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v")), "m")["v"].alias("parent")))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("node").alias("root"), "parent")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        to = lambda c, name: parents.select(F.col("node").alias(c), F.col("parent").alias(name))
        edges = settled(edges.join(to("src", "a"), "src").join(to("dst", "b"), "dst").where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if edges.isEmpty():
            return labels


def nearest_marked(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, nearest, up): the nearest marked node above each node of a forest, and how many levels above it stands.

    ``nodes``: (id, parent), each id once; ``marked``: (id). Pointers double: a round joins every open node with the node
    that its pointer has reached, so the rounds grow with the logarithm of the depth. Nodes without a marked one above,
    also those on a cycle without marks, are left out; a parent that is no node counts if it is marked.
    """
    marks = marked.select(F.col("id").alias("parent"), F.lit(True).alias("_m")).where("parent is not null").distinct()
    hit = F.coalesce("_m", F.lit(False))
    # What lies up to ``span`` levels above: the nearest marked node, else the last node looked at.
    state = settled(nodes.where("id is not null and parent is not null").join(marks, "parent", "left").select("id", F.when(hit, F.col("parent")).alias("nearest"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("span")))
    found = state.where("nearest is not null").select("id", "nearest", F.col("span").alias("up"))
    rounds, open_ = max(1, state.count()).bit_length() + 1, state.where("nearest is null")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        above = state.select(F.col("id").alias("at"), F.col("nearest").alias("n"), F.col("at").alias("a"), F.col("span").alias("s"))
        moved = open_.select("id", "at", "span").join(above, "at").select("id", F.col("n").alias("nearest"), F.col("a").alias("at"), (F.col("span") + F.col("s")).alias("span"))
        state = settled(moved.unionByName(state.where("nearest is not null").select("id", "nearest", "at", "span")))
        open_ = state.where("nearest is null")
        found = state.where("nearest is not null").select("id", "nearest", F.col("span").alias("up"))
    return found
