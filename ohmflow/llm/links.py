"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node with an edge;
    component is the smallest node reachable. Each round is joins and partial
    aggregates; rounds grow with the logarithm of the longest path. Empty
    edges give an empty table."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                            F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v")).where("u <> v")
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        e = stored(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
