"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.common import folders_of, materialise, remove_written


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component) for every node that has an edge; component is its smallest node.

    Each step is a grouped minimum (combined before the shuffle, so a hub is no hot key there) and an equi-join;
    the number of rounds grows with the logarithm of the longest path.
    """
    pairs = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, pairs = pairs, materialise(small.filter("u <> v").distinct(), "edges")
        remove_written(folders_of(last), pairs.sparkSession)
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
