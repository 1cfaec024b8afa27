"""Connected components by alternating stars, each round a few joins and a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them.

    Large: every node passes its larger neighbours on. Small: every node passes itself and
    its smaller neighbours on. Minima are combined before the shuffle, and a node with very
    many neighbours meets its minimum in a join that adaptive execution can split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    passed = edges.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.union(lowest.select("a", F.col("m").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node in ``pairs`` (a, b): label is the least node of its component."""
    ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    edges = stored(ordered, "edges")
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False).where("a != b").distinct(), "edges")
        # Edges that no longer change are stars: every node points at its least.
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before or not now[0]:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
