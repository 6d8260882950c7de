"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import forget, stored


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids in edges (a, b), two longs: root is the smallest id that edges reach from id.

    Alternating stars: in turn every node links its larger neighbours to its least one, and its smaller neighbours and itself
    to the least of them, until nothing changes, which takes about the logarithm of the longest path. A step is aggregates
    and joins on the node, so that no node's edges have to meet in one task; each step is stored and the one before deleted.
    Edges of a node with itself and nulls add nothing.
    """
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = stored(edges.where("a is not null and b is not null and a <> b").select(*pair).distinct(), "edges")
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        parts = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(below, "u").select(F.explode(parts).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        past, now = now, stored(small, "edges")
        forget(past)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = state
