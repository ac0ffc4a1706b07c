"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of ids to ``(node, component)``, the component being the smallest id that can be reached.

    Each round points every node's larger neighbours, then every smaller one, at the smallest neighbour; the number of
    rounds grows with the logarithm of the longest path. Minima are aggregated before they are shuffled and joined
    back, so no neighbourhood is ever gathered. Links are stored after each round. Null ids link nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stored(edges.filter((F.col("a") != F.col("b"))).distinct(), "links")
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stored(large.distinct(), "links")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter(F.col("lo") != F.col("m")).select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")
        )
        edges = stored(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "links")
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
