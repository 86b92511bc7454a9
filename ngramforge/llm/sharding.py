"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is the documents of one text, so that copies share a shard.  Groups are put in order of
size, the largest first, and each enters the shard with the least capacity left that holds it.
Groups of one size are alike, and so are shards with the same capacity left: the driver packs the
histogram of sizes, taking whole runs of equal shards from a balanced tree, and hands out ranges of
ranks.  The groups themselves stay in Spark, which ranks them within their size.  Groups beyond the
capacity count as one size, so the histogram has one row for each byte of the capacity at most,
whatever the input.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.llm.common import content, cut, second, table

#: Bytes of UTF-8 text that a shard holds.
CAPACITY = 8 << 20
#: Groups of one size are ranked in so many parts, by the leading bits of their keys.
RANK_BITS = 12
#: Ranks that a range of them is cut into where it meets the groups.
SPAN = 256


class Tree:
    """Balanced search tree (a treap) from capacity left to the runs of shards that have it."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, runs, left, right]
        self.random = random.Random(0)

    def add(self, key: int, run: tuple[int, int]) -> None:
        self.root = self._add(self.root, key, run)

    def _add(self, node: list | None, key: int, run: tuple[int, int]) -> list:
        if node is None:
            return [key, self.random.random(), [run], None, None]
        if key == node[0]:
            node[2].append(run)
            return node
        side = 3 if key < node[0] else 4
        node[side] = child = self._add(node[side], key, run)
        if child[1] > node[1]:
            node[side], child[7 - side] = child[7 - side], node
            return child
        return node

    def tightest(self, least: int) -> list | None:
        """Node of the smallest key that is at least that."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= least:
                best, node = node, node[3]
            else:
                node = node[4]
        return best

    def remove(self, key: int) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node: list, key: int) -> list | None:
        if key != node[0]:
            side = 3 if key < node[0] else 4
            node[side] = self._remove(node[side], key)
            return node
        left, right = node[3], node[4]
        if left is None or right is None:
            return right if left is None else left
        if left[1] > right[1]:
            node[3], left[4] = left[4], node
            left[4] = self._remove(node, key)
            return left
        node[4], right[3] = right[3], node
        right[3] = self._remove(node, key)
        return right


def assign(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit for (size, groups) in falling size, and the number of shards.

    A row for each range of ranks: size, first rank, end of ranks, first shard, groups a shard.
    Ranks of a size start at 0.  A group larger than the capacity has a shard of its own.
    """
    tree, out, shards = Tree(), array("q"), 0
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            if size > capacity:
                out.extend((size, rank, count, shards, 1))
                shards += left
                break
            if size == 0:
                shards = max(shards, 1)
                out.extend((size, rank, count, 0, left))
                break
            node = tree.tightest(size)
            if node is None:
                fits = capacity // size
                tree.add(capacity, (shards, -(-left // fits)))
                shards += -(-left // fits)
                continue
            room, runs = node[0], node[2]
            first, n = runs.pop()
            if not runs:
                tree.remove(room)
            fits = room // size
            full = min(n, left // fits)
            if full:
                out.extend((size, rank, rank + full * fits, first, fits))
                rank += full * fits
                tree.add(room - fits * size, (first, full))
            rest = min(count - rank, fits) if full < n else 0
            if rest:
                out.extend((size, rank, rank + rest, first + full, rest))
                rank += rest
                tree.add(room - rest * size, (first + full, 1))
            if n - full - bool(rest) > 0:
                tree.add(room, (first + full + bool(rest), n - full - bool(rest)))
    return np.frombuffer(out, np.int64).reshape(-1, 5) if len(out) else np.zeros((0, 5), np.int64), shards


def shard(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Shard of each document.

    Returns (doc_id, shard, n_bytes, group_bytes), a row for each row of docs.  Null and empty
    texts have no bytes: they are two groups, and go to the first shard.  A group beyond the
    capacity has a shard of its own; those come first.  A null doc_id stays; repeated rows are in
    one group; equal sizes are ranked by the text's keys; an empty table gives no rows; further
    columns are left out.  Texts are read once; only keys and sizes are moved; the driver gets the
    histogram of sizes.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    narrow = cut(docs.select("doc_id", content().alias("g"), F.when(F.col("text").isNotNull(), second()).alias("h"), size.alias("n_bytes")))
    # No text has null for its second key, so null texts are a group of their own.
    narrow = narrow.withColumn("none", F.col("h").isNull()).withColumn("h", F.coalesce("h", F.lit(0).cast("long"))).withColumn("g", F.coalesce("g", F.lit(0).cast("long")))
    group = ["none", "g", "h"]
    groups = narrow.groupBy(*group).agg(F.sum("n_bytes").alias("group_bytes")).withColumn("size", F.least("group_bytes", F.lit(capacity + 1)))
    groups = cut(groups.withColumn("bucket", F.shiftright("g", 64 - RANK_BITS)))
    per = cut(groups.groupBy("size", "bucket").agg(F.count("*").alias("n")))
    rows = per.groupBy("size").agg(F.sum("n").alias("n")).toArrow()
    ranges, _ = assign(zip(rows.column("size").to_pylist(), rows.column("n").to_pylist(), strict=True), capacity)
    plan = spark.createDataFrame(pa.table([*ranges.T], names=["size", "lo", "hi", "first", "each"]))
    spans = plan.withColumn("span", F.explode(F.sequence(F.expr(f"lo div {SPAN}"), F.expr(f"(hi - 1) div {SPAN}"))))
    # Ranks go on from part to part of a size: no part is sorted by one task but the groups of its keys.
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("size", "bucket").orderBy(*group)
    ranked = groups.withColumn("i", F.row_number().over(own) - 1).join(base, ["size", "bucket"]).withColumn("rank", F.col("base") + F.col("i"))
    placed = ranked.withColumn("span", F.expr(f"rank div {SPAN}")).join(spans, ["size", "span"]).where("rank >= lo AND rank < hi")
    placed = placed.select(*group, "group_bytes", (F.col("first") + F.expr("(rank - lo) div each")).alias("shard"))
    return narrow.join(placed, group).select("doc_id", "shard", "n_bytes", "group_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
