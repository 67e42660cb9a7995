"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumigrid.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("u"), F.least("a", "least").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), component being the least node that can be reached.

    Each round is a grouped minimum and a join; a node with many edges is pre-aggregated and its join side can be split.
    Edges are written to the shared folder after each round, so a lost executor costs one round at most; the edges of
    the round before are removed. Edges of a node with itself are allowed; no edges give no rows; null ends are left out.
    """
    loops = edges.where("a = b").select("a", "b")
    last, state = Scratch(edges.sparkSession), None
    now = last.table(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        new = Scratch(edges.sparkSession)
        now = new.table(_small_star(_large_star(now)).distinct(), "edges")
        last.clear()
        last = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.union(centres).union(loops).groupBy("node").agg(F.min("component").alias("component"))
