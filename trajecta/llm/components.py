"""Connected components of a link table by alternating star contractions (distributed, any size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the smallest node reachable.

    Each round joins links with their ends' smallest neighbours and shrinks paths towards the root;
    the number of rounds grows with the logarithm of a component's diameter. Links stay in the
    cluster; only the count of changed links comes to the driver. Self-links and repeats do no harm.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # Large star: the larger neighbours of each node move to its smallest neighbour.
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"), (F.col("x") != F.col("m")).alias("moved"))
        large = large.groupBy("v", "u").agg(F.max("moved").alias("moved"))
        # Small star: the smaller neighbours of each node, and the node itself, move to the smallest of them.
        down = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), F.max("moved").alias("moved"))
        kept = large.join(down.select("v", "m", "n"), "v")
        small = kept.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(down.select("v", F.col("m").alias("u"))).distinct()
        small = materialise(small, "links")
        stable = small.count() == links.count() and small.exceptAll(links).isEmpty()
        links = small
        if stable:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
