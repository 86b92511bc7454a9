"""Training on a stream of sentences, and segmentation of a stream by a fixed model.

Statistics follow from counts, so only counts are state: either Spark's own (counts), or a table
with a version for each micro-batch (train_batches), which may also be pruned between batches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ngramforge.operators import counts as C
from ngramforge.operators.segment import segment
from ngramforge.plans.model import NgramModel

_VERSION = re.compile(r"version=(\d+)$")


def counts(sentences: DataFrame, length: int, longest: int | None = None) -> DataFrame:
    """Running counts of a stream of sentences, for the update and complete modes; the empty n-gram is counted as a row of its own."""
    rows = C.padded(sentences, length)
    every = C.windows(rows, longest or length).unionByName(C.roots(rows))
    return C.summed(every)


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to the end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions in the folder that were written to the end."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(hadoop)
    if not files.exists(folder):
        return []
    found = (_VERSION.search(s.getPath().toString()) for s in files.listStatus(folder))
    return sorted(v for v in (int(m[1]) for m in found if m) if _done(spark, f"{path}/version={v}"))


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def add_batch(sentences: DataFrame, version: int, path: str, length: int, prune: int = 0) -> None:
    """Writes the counts of that version: those of the latest one before and of the sentences, less prune.

    A version that is written again, after a failure, gives the same table, as it never reads itself.
    Two versions before it are kept.
    """
    spark = sentences.sparkSession
    old = [v for v in _versions(spark, path) if v < version]
    model = NgramModel(spark, length, spark.read.parquet(f"{path}/version={old[-1]}") if old else None).add(sentences)
    if prune:
        model = model.prune(prune)
    model.counts.write.mode("overwrite").parquet(f"{path}/version={version}")
    for v in old[:-2]:
        _drop(spark, f"{path}/version={v}")


def train_batches(sentences: DataFrame, path: str, checkpoint: str, length: int, prune: int = 0, **trigger) -> StreamingQuery:
    """Grows the model in path by each micro-batch; trigger as of DataStreamWriter, all that is there by default."""
    step = lambda batch, number: add_batch(batch, number, path, length, prune)
    return sentences.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, length: int) -> NgramModel:
    """The model as of the last micro-batch; empty where there is none."""
    done = _versions(spark, path)
    return NgramModel(spark, length, spark.read.parquet(f"{path}/version={done[-1]}").select(*C.COUNTS)) if done else NgramModel(spark, length)


def segment_stream(sentences: DataFrame, scores: DataFrame, order: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Segments each micro-batch by a fixed table of scores, to Parquet by batch; a batch that is repeated overwrites itself.

    The scores are written beside the checkpoint when the stream first starts and read from there
    by each batch, and by the stream when it goes on later.
    """
    spark = scores.sparkSession
    fixed = f"{checkpoint.rstrip('/')}.scores"
    if not _done(spark, fixed):
        scores.where("autonomy IS NOT NULL").select("k", "ngram", "autonomy").write.mode("overwrite").parquet(fixed)

    def step(batch: DataFrame, number: int) -> None:
        segment(batch, spark.read.parquet(fixed), order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sentences.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
