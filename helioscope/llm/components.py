"""Connected components of an edge table by alternating stars; nothing but two sums a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_join, materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(row, root) of each node of edges (a, b): root is the smallest node that it reaches. Loops and repeated edges are harmless.

    Each round ties the larger neighbours of every node to its least one, then the smaller ones; the number of
    rounds grows with the logarithm of the longest path. A node with very many neighbours is split over tasks.
    """
    state = None
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        total = now.count()
        if not total:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("m", "a").alias("m"), "n")
        large = heavy_join(both.filter("b > a"), least, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), label)
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = heavy_join(large, down, ["a"], "n", total).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now = materialize(small.filter("a <> b").distinct(), label)
        last, state = state, tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if state == last:
            break
    return now.select(F.col("a").alias("row"), F.col("b").alias("root"))
