"""Connected components over an edge table, as alternating large-star / small-star joins.

Each round replaces edges by edges to smaller neighbours, so the graph turns into stars whose centres are the smallest
ids. A node's neighbours are never gathered in one place: each round only needs ``min`` per node (which pre-aggregates
before the shuffle) and equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` undirected -> ``(node, component)`` for every node on an edge; component = smallest reachable id.

    Self loops, repeated edges and null ends are ignored; no edges give an empty result.
    """
    edges = pin(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    nodes = pin(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node hangs on the smallest of the node and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pin(large.where("a <> b").distinct())
        # Small star: every smaller neighbour of a node, and the node, hang on the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = pin(small.where("a <> b").distinct(), replaces=edges)
        unpin(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )
