"""Connected components by star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from millaudit.llm.common import written


#: Edges that one task of a round takes, and the least number of tasks; an edge is two numbers.
TASK_EDGES, LEAST_TASKS = 50_000, 8


@contextmanager
def fitted_shuffles(spark: SparkSession, edges: int) -> Iterator[None]:
    """Shuffles of no more tasks than so many edges need; many edges keep the session's number. Only for steps that run inside."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(LEAST_TASKS, edges // TASK_EDGES + 1))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of its component.

    Rounds alternate: every neighbour above a node moves to the node's smallest neighbour, then every neighbour below.
    All steps are a grouped minimum, combined before the shuffle, and a join with it, so a node with very many
    neighbours is never gathered. A round's edges are written to the shared folder; the number of rounds grows with
    the logarithm of the longest path. Few edges are dealt to few tasks.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    with fitted_shuffles(edges.sparkSession, edges.count()):
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small_least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = written(moved.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
