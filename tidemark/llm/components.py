"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
    return row["n"], row["h"]


def components(links: DataFrame, nodes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``node, component`` (the least node reachable) for each node of a link; links of a node to itself don't matter.

    Each round points every node at the least of its neighbours, first the larger ones, then the smaller ones;
    the rounds grow with the logarithm of the longest chain. Least neighbours are added up before the shuffle and
    read from disk for the join, so a node with very many links is split by adaptive execution.
    """
    x, y = F.col(nodes[0]).cast("long"), F.col(nodes[1]).cast("long")
    edges = written(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        edges = written(both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # Every edge now has its larger end first.
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        pairs = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(pairs.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
