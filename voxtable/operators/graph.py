"""Connected components of a link table, with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.session import written


def linked_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node in a link table with columns a and b.

    Alternating large-star and small-star rounds: each node sends its larger, then its smaller neighbours to the smallest one. The links left are
    stars, after a number of rounds that grows with the logarithm of a component's size. Self links and repeated links are harmless.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    last = None
    while True:
        # Large star: of all neighbours of u, the larger ones go to the smallest (or to u).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its smaller neighbours go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small, "edges")
        # A fingerprint of the whole table: unchanged means that only stars are left.
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = (state.n, state.h)
