"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ngramforge.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for edges (a, b) of longs.

    Large-star and small-star steps in turn: every node links its larger neighbours, then its
    smaller ones and itself, to its least neighbour.  The number of rounds grows with the
    logarithm of the longest path; edges are cut from their lineage each round.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = cut(both)
    before = None
    while True:
        ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before:
            break
        both, before = after, tuple(state)
    return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
