"""Connected components of an edge table, by alternating star contraction.

Every round rewires neighbours to the smallest id that they know, first those
above a node and then those below it; rounds grow with the logarithm of the
longest path.  Edges stay distributed, hot nodes are summed up by partial
aggregates, and every round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import reliable


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: long columns a and b.  Returns (node, component) for every node with an edge; component is its smallest reachable id."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = reliable(spark, e)
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a")
        e = reliable(spark, down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
