"""Connected components of a link table by large-star / small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node that has a link.

    ``links`` has columns a, b of one orderable type; direction, repeats and
    self-links do not matter. Returns node, root for the nodes in links; a node
    without a link is its own component and is not listed. Each round is two
    aggregations on the link table, staged, and the number of rounds grows with the
    logarithm of the longest chain. A node's neighbours are never gathered in one
    task: a round only takes the minimum of a node's neighbours (combined before the
    shuffle) and joins it back. Null ends are ignored; an empty table gives none.
    """
    edges = stage(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.filter(F.col("u") != F.col("v")).distinct(), "cc-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
