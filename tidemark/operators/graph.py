"""Reachability in coupling graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``a, b``: all pairs with a path from ``a`` to ``b``. Edges with a null end lead nowhere and are left out.

    Each round joins only the pairs that the round before found, to both sides of all pairs so far, so that the paths that are
    covered double: a chain of n edges takes about log n rounds. It stops by itself when a round finds nothing new.
    Pairs are written each round, which ends the lineage.
    """
    every = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct(), "closure")
    fresh = every
    while True:
        longer = fresh.select("a", F.col("b").alias("m")).join(every.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        longer = longer.unionByName(every.select("a", F.col("b").alias("m")).join(fresh.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
        fresh = written(longer.distinct().join(every, ["a", "b"], "left_anti"), "closure")
        if fresh.isEmpty():
            return every.select(F.col("a").alias(a), F.col("b").alias(b))
        every = written(every.unionByName(fresh), "closure")
