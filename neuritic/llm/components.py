"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge to another; null ends and loops
    are left out.

    Every round is written to the shared folder. Each joins the edges with the smallest neighbour of their ends. These
    neighbours are written too, so that both sides of the join are read afresh and Spark splits the edges of a node that
    very many others have.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        least = stored(least, "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.filter("u != v").distinct(), "edges")
        for used in (now, least, large, low):
            drop_stored(used)
        now = after
        mark = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.groupBy("v").agg(F.count(F.lit(1))).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
