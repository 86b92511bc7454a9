"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into word arrays at a time.
SLICE_BYTES = 4_000_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set and driver and executors are one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = spark.sparkContext.getCheckpointDir()
    if at:
        return named or at
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there on: later steps don't recompute it, whatever executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until no column of docs is called like them in either case."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def content(text: Column | str = "text") -> Column:
    """64-bit key of a text.  Two texts of n share it with probability n * n / 2**65; where that matters second() decides."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def second(text: Column | str = "text") -> Column:
    """Another 64-bit key of a text, independent of content()."""
    return F.xxhash64(F.lit(7), F.col(text) if isinstance(text, str) else text, F.lit(7))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about limit bytes of that string column, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Returns memory that Arrow and the allocator keep for later to the system: a Python worker outlives its task, and the tasks of later stages share the executor with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(texts: pa.Array, normal: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and 64-bit hashes of the whitespace-separated words; a null text has none.

    normal maps a word before hashing; words that it empties are left out.
    """
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    if normal:
        names = [normal(x) for x in names]
    hashed = np.fromiter((xxhash.xxh64_intdigest(x.encode()) if x else 0 for x in names), U64, len(names))
    full = np.fromiter((x != "" for x in names), bool, len(names))
    if full.all():
        return offsets, hashed[codes]
    keep = full[codes]
    before = np.concatenate(([0], np.cumsum(keep)))
    return before[offsets], hashed[codes[keep]]


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """For each element the index of its segment."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged_take(offsets: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the segments named by which, in that order."""
    size = (offsets[1:] - offsets[:-1])[which]
    out = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(out[-1]) + np.repeat(offsets[which] - out[:-1], size)
    return out, values[index]


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Rows in order, cut between groups only; with most, larger groups are cut after that many rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 8192:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = np.zeros(rows, bool)
        for key in keys:
            x = whole.column(key).to_numpy()
            last |= x != x[-1]
        end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if most and not end:
            end = rows - rows % most
        if end:
            yield whole.slice(0, end)
            whole = whole.slice(end)
        held, rows = whole.to_batches(), whole.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of rows with equal keys begin, and the end of the last."""
    new = np.zeros(len(keys[0]) + 1, bool)
    new[[0, -1]] = True
    for x in keys:
        new[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
