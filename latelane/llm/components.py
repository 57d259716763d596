"""Connected components of a graph given as a table of edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from latelane.llm.common import written

EDGES_PER_FILE = 50_000


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node (a) to the smaller (b)."""
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _round(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one, then all its smaller."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), "least")
    large = _oriented(large.withColumnRenamed("least", "b"))
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return _oriented(large.join(least, "a").select(ends, F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches with another node.

    The component is its smallest node. Minima are combined before the shuffle, and a node
    of many edges is a skewed join only. Each round is written, in files of a bounded
    number of edges, so a lost executor costs the current one. They end when every
    component is a star, that is when no node has both a larger and a smaller neighbour
    and each has one smaller.
    """
    edges = written(_oriented(edges), "edges")
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        several = edges.groupBy("a").count().where("count > 1")
        if inner.isEmpty() and several.isEmpty():
            break
        # A round never has more edges than twice those before it.
        edges = written(_round(edges).coalesce(max(1, n // EDGES_PER_FILE)), "stars")
        n = edges.count()
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
