"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that occurs in ``links`` (a, b long).

    Alternates large-star and small-star steps until the links no longer change: every component ends as a star around
    its smallest node, in a number of rounds that grows with the logarithm of the size of a component. A node's
    neighbours are never gathered: minima are aggregated and joined back, and each round is spooled to the shared folder.
    Links from a node to itself, repeated links and links in both directions are allowed; nulls are ignored. More rounds than
    ``rounds`` (enough for any component that a cluster can hold) raise a ``RuntimeError`` rather than give a part.
    """
    edges = spool(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(smallest.select("a", F.col("m").alias("b"))).distinct()
        after = spool(small)
        digest = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_spool(edges)
        edges = after
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds; allow more")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
