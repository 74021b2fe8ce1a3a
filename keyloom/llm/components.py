"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: Edges of a node, two numbers each, from which it doesn't share a task with others.
HOT_EDGES = 1000


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    # a hub has as many edges as its group has members
    return join_counted(both.where("v > u"), least, "u", "degree", 2 * n_edges, HOT_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = join_counted(down, least, "u", "degree", n_edges, HOT_EDGES).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node but the roots; ``edges`` has columns u, v.

    Each round is written to the shared folder; only two numbers a round come
    back to the driver, to see whether anything still changes.
    """
    spark = edges.sparkSession
    now, mark = _written(edges.select("u", "v").where("u <> v").distinct(), name)
    while True:
        now, seen = _written(_small_star(_large_star(now, mark[0]), mark[0]).distinct(), name)
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, object]]:
    """The edges, written, with their number and a sum of their hashes, taken while they were written."""
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    table = materialize(edges.sparkSession, edges.observe(seen, *sums), name)
    return table, (seen.get["n"], seen.get["h"])
