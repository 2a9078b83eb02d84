"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import discard, join_counted, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component_id`` (the component's smallest node) of every node of ``edges(a, b)`` but the smallest ones.

    Each round hangs every node's neighbours on the smallest of them; the rounds are logarithmic in the longest path.
    Edges stay distributed and are written once a round; a centre that most edges have is not one task's.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now, before = written(pairs), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = written(join_counted(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        lowest = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_counted(large, lowest, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        old, now = now, written(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        discard(old, least, large, lowest)
