"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, from edges (a, b) of longs.

    Each round links every node to the smallest of its neighbours, once upwards and once downwards,
    until nothing moves; a path halves with each round. Smallest neighbours are aggregated before
    the shuffle, and edges meet them in a join that Spark splits where a node has many. Every round
    is stored, so no round is computed twice. Nodes without edges are not listed; self-loops and
    repeated edges do no harm.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct(),
        f"{name}-0",
    )
    mark, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # read twice below, from one exchange
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
        turn += 1
        edges = stored(small.where("a > b").distinct(), f"{name}-{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
