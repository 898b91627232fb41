"""Connected components of a graph of long ids by joins and grouping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every id of edges (a, b): root is the smallest id of its component.

    Alternating stars: each round links every larger neighbour, then every smaller one, to the
    smallest neighbour, until nothing changes. Rounds grow with the logarithm of the longest
    path. Loops and repeated edges don't matter; ids with only loops aren't returned.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select("a", F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
