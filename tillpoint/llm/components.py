"""Connected components of an edge table by alternating large and small stars
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.io import drop, stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang each node's larger (or smaller) neighbours on the least
    node of its neighbourhood.  The least node is a partial aggregate; the join that
    hands it back is split by AQE where a node has very many neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v <= u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    moved = hung.where("v > u") if large else hung.where("v <> m")
    out = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = out.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return out if large else out.distinct()


def near_labels(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the least node within two edges of each node: all nodes
    of a star get one label, and nodes of one label are always connected."""
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    once = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    there = both.join(once.select(F.col("u").alias("v"), "m"), "v")
    return there.groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on at most one other, and that one on none."""
    ends = edges.select(F.col("v").alias("k"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("u", F.lit(0), F.lit(1)))
    per = ends.groupBy("k").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per.where("hangs > 1 or hangs = 1 and holds = 1").limit(1).count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is the
    least node reachable.  Nulls and loops are ignored; an edge may repeat.

    Each round is written to the shared folder, so a lost executor costs one round at
    most.  It ends when the edges are stars, each on its least node.  Rounds grow with the logarithm of the size; the edge table never grows."""
    spark = edges.sparkSession
    now, path = stash(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                      .distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        new, new_path = stash(_stars(_stars(now, large=True), large=False), "edges")
        drop(spark, path)
        now, path = new, new_path
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
