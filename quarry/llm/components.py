"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); the root is the least node that can be reached.

    Large star: every greater neighbour of a node is linked to the least one. Small star: the others are.
    Each round is two group-and-join steps over the links and is written to the shared folder; links never
    come together on the driver or in one group. Long chains take a logarithmic number of rounds.
    """
    pairs = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = pairs.union(pairs.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v")).distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v")).distinct()
