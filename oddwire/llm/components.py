"""Connected components of links between numbers, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddwire.llm.shared import written


def _least(both: DataFrame) -> DataFrame:
    """Smallest neighbour, or the node itself; written, so that joins may split a hot node."""
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return written(least.select("a", F.least("a", "m").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    higher = both.where("b > a").join(_least(both), "a")
    return higher.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    lower = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(lower)
    moved = lower.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest number each linked node can reach, itself included.

    ``links`` has the columns a and b; both directions and repetitions may occur, links to oneself
    and links to null are ignored. Alternates the large and the small star operation until nothing
    changes, which takes about log(nodes) rounds of linear size.
    """
    edges = written(links.where("a <> b").distinct(), "links")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        before = state
