"""Connected components of a graph held as a DataFrame of edges.

Large-star and small-star steps take turns: each joins every node's neighbours to the smallest of them, which keeps
the components and ends, after about log(n) rounds, with every node joined to the smallest node of its component. The
smallest neighbour is a partial aggregate, so a hub's edges are never gathered; its edges in the join that follows are
split by adaptive execution. Each round is written to the shared folder, over the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``root`` (the smallest node that can be reached) of every node that has an edge to another node.
    Loops, repeated edges and nulls are ignored; no edge gives no row. The result is the table ``stars`` of ``scratch``."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    edges = scratch.put(edges.distinct(), "stars")
    before = None
    for _ in range(MOST_ROUNDS):
        mark = _mark(edges)
        if mark == before or not mark[0]:
            scratch.drop("large-stars")
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.put(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = scratch.put(small, "stars")
    raise RuntimeError("components did not settle")
