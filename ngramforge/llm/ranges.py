"""Documents in their order, cut into shards by their keys.

A shard begins with each document whose key has a hash divisible by a number: shards hold that many
documents on average whatever the ids are, near or far apart, hashed or null, and their bounds do
not depend on how rows are spread over files and tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ngramforge.llm.common import content, cut

#: Shard bounds that tell the tasks' ranges apart, at most.
BOUNDS = 1 << 18


def _part(keyed: DataFrame, every: int) -> Column:
    """Number of the task's range that a row of keyed (last, place, key, mark) is in: how many chosen shard bounds are not above it.

    Of the bounds each power of two leaves half; the first power that leaves BOUNDS at most is
    taken, so the driver gets a bounded number, and no shard is cut in two.
    """
    level = F.expr(f"CASE WHEN mark = 0 THEN 64 ELSE length(bin(mark div {every})) - length(trim(TRAILING '0' FROM bin(mark div {every}))) END")
    starts = cut(keyed.where(F.col("mark") % every == 0).select("last", "place", "key", level.alias("level")).distinct())
    held, depth = 0, 0
    for row in starts.groupBy("level").count().orderBy(F.desc("level")).collect():
        if held + row["count"] > BOUNDS:
            depth = row["level"] + 1
            break
        held += row["count"]
    bounds = sorted(map(tuple, starts.where(F.col("level") >= depth).select("last", "place", "key").collect()))
    shared = keyed.sparkSession.sparkContext.broadcast(
        [(np.array([p for la, p, _ in bounds if la == side], np.int64), np.array([k for la, _, k in bounds if la == side], np.int64)) for side in (False, True)]
    )

    @pandas_udf("int")
    def number(last: pd.Series, place: pd.Series, key: pd.Series) -> pd.Series:
        last, place, key = last.to_numpy(), place.to_numpy(), key.to_numpy()
        out = np.zeros(len(place), np.int32)
        before = 0
        for side, (places, keys) in enumerate(shared.value):
            own = last == bool(side)
            lo, hi = np.searchsorted(places, place[own]), np.searchsorted(places, place[own], side="right")
            same = np.flatnonzero(hi > lo)
            lo[same] += np.array([np.searchsorted(keys[a:b], k, side="right") for a, b, k in zip(lo[same], hi[same], key[own][same], strict=True)], np.int64)
            out[own] = before + lo
            before += len(places)
        return pd.Series(out)

    return number("last", "place", "key")


def in_order(docs: DataFrame, every: int) -> DataFrame:
    """(part, place, key, starts, doc_id, text) of docs in the order of doc_id, then the text's key, null ids last: each task has ranges of it.

    starts: whether a shard begins; every documents are between two of those on average.  Texts
    are shuffled once.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce(content(), F.lit(0).cast("long")))
    keyed = keyed.withColumn("last", F.col("doc_id").isNull()).withColumn("place", F.coalesce("doc_id", "key")).withColumn("mark", F.xxhash64("last", "place", "key"))
    rows = keyed.withColumn("part", _part(keyed.select("last", "place", "key", "mark"), every)).withColumn("starts", F.col("mark") % every == 0)
    rows = rows.select("part", "last", "place", "key", "starts", "doc_id", "text").repartition("part").sortWithinPartitions("part", "last", "place", "key")
    return rows.select("part", "place", "key", "starts", "doc_id", "text")


class Numbers:
    """Numbers the shards of rows that a task of in_order() meets, rising in the order of the documents; rows equal in id and text are of one shard."""

    def __init__(self) -> None:
        self.part, self.place, self.key, self.number = -1, 0, 0, 0

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        part, place, key, starts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "place", "key", "starts"))
        if not len(part):
            return np.zeros(0, np.int64)
        new = part != np.append(self.part, part[:-1])
        begin = new | (starts & ((place != np.append(self.place, place[:-1])) | (key != np.append(self.key, key[:-1]))))
        count = np.cumsum(begin)
        first = np.maximum.accumulate(np.where(new, count, 0))
        number = np.where(first > 0, count - first, self.number + count)
        self.part, self.place, self.key, self.number = int(part[-1]), int(place[-1]), int(key[-1]), int(number[-1])
        return (part.astype(np.int64) << 32) + number
