"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node it reaches) for every node with an edge. edges: a, b (long).

    Alternates large-star and small-star steps, each a grouped aggregation and a join on the node, until nothing changes:
    a number of rounds that grows with the logarithm of the longest chain. Nothing is collected.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        then, now = now, materialise(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(then)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own), "components")
    release(now)
    return out
