"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm._common import attach, written


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return written(edges.groupBy(F.col(key).alias("_k")).agg(F.min(other).alias("_m"), F.count(F.lit(1)).alias("n")), "least", narrow=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the component's smallest node.

    Each round writes its tables to the shared folder; the number of rounds grows with the logarithm of the longest
    path. A hub's edges are joined through ``attach``, so no node gathers in one task. No edges: no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both, "a", "b")
        star = attach(both.withColumn("_k", F.col("a")), low, ["_k"], "inner", "n")
        large = star.filter("b > a").select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).filter("a <> b").distinct()
        large = written(large, "large", narrow=True)
        low = _least(large, "a", "b")
        star = attach(large.withColumn("_k", F.col("a")), low, ["_k"], "inner", "n")
        small = star.filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        now = written(small.union(low.select(F.col("_k").alias("a"), F.col("_m").alias("b"))).distinct(), "edges", narrow=True)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
