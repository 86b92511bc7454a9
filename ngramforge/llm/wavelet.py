"""Token shards as wavelet matrices: bit planes with rank and select in one compressed file.

Plane l holds bit l of the token ids in the order to which the planes above have sorted them: all
zeros of a plane come before its ones.  A directory counts the ones before each block of 512 bits.
One file of n tokens answers which token stands at i, how often a token occurs before i and where
its k-th occurrence is, without being expanded to ids.  Layout: magic, length of a JSON header,
header, sections; each section is a zstd frame: document ids, document offsets, then each plane
and its directory.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ngramforge.llm.bpe import RANKS, coder, load_ranks
from ngramforge.llm.common import SLICE_BYTES, slices, table
from ngramforge.llm.ranges import Numbers, in_order

MAGIC = b"WVMX1\0\0\0"
BLOCK = 512
#: Tokens after which a shard is closed; it ends with the document that reaches this.
SHARD_TOKENS = 1 << 21
#: Mean number of documents between those that begin a shard whatever the one before holds.
SHARD_DOCS = 4096


def planes(ids: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """Packed plane and number of zeros for each bit, the highest first."""
    out = []
    x = ids.astype(np.uint16) if bits <= 16 else ids.astype(np.uint32)
    for level in range(bits - 1, -1, -1):
        one = (x >> level) & 1 == 1
        out.append((np.packbits(one, bitorder="little"), len(x) - int(np.count_nonzero(one))))
        x = np.concatenate((x[~one], x[one]))
    return out


def directory(plane: np.ndarray, n: int) -> np.ndarray:
    """Ones before each block, and in all."""
    full = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), np.uint8)
    full[: len(plane)] = plane
    ones = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))


def pack(ids: np.ndarray, doc_ids: list[int | None], offsets: np.ndarray, bits: int) -> bytes:
    """The file of a shard: its tokens and where each document starts."""
    zip_ = zstandard.ZstdCompressor(level=1)
    levels = planes(ids, bits)
    null = [i for i, x in enumerate(doc_ids) if x is None]
    sections = [np.array([0 if x is None else x for x in doc_ids], np.int64), offsets.astype(np.int64)]
    for plane, _ in levels:
        sections += [plane, directory(plane, len(ids))]
    frames = [zip_.compress(x.tobytes()) for x in sections]
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": [z for _, z in levels], "null": null, "sizes": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *frames])


class WaveletMatrix:
    """Reads the file of a shard; sections are expanded when first used."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<Q", blob[8:16])
        head = json.loads(blob[16 : 16 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        ends = np.cumsum([16 + size, *head["sizes"]])
        self._blob, self._ends = blob, ends
        self._open: dict = {}
        self.doc_ids: list[int | None] = self._section(0, np.int64).tolist()
        for i in head["null"]:
            self.doc_ids[i] = None
        self.offsets = self._section(1, np.int64)

    def _section(self, i: int, kind: type) -> np.ndarray:
        if i not in self._open:
            self._open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._blob[self._ends[i] : self._ends[i + 1]]), kind)
        return self._open[i]

    def _words(self, level: int) -> np.ndarray:
        """A plane as 64-bit words, whole blocks of them."""
        if ("w", level) not in self._open:
            plane = self._section(2 + 2 * level, np.uint8)
            full = np.zeros((-(-max(self.n, 1) // BLOCK)) * (BLOCK // 8), np.uint8)
            full[: len(plane)] = plane
            self._open["w", level] = full.view(np.uint64)
        return self._open["w", level]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first bits of a plane, for each number of bits."""
        words, word = self._words(level), at >> 6
        block = at // BLOCK
        total = self._section(3 + 2 * level, np.uint32)[block].astype(np.int64)
        first = block * (BLOCK // 64)
        for k in range(BLOCK // 64 - 1):
            inside = first + k < word
            total += np.where(inside, np.bitwise_count(words[np.where(inside, first + k, 0)]), 0)
        part = np.minimum(word, len(words) - 1)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return total + np.where(at & 63, np.bitwise_count(words[part] & low), 0)

    def _bits(self, level: int, at: np.ndarray) -> np.ndarray:
        return ((self._section(2 + 2 * level, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def _before(self, level: int, bit: int) -> np.ndarray:
        """Such bits before each block of a plane: what select searches."""
        ones = self._section(3 + 2 * level, np.uint32)
        if bit:
            return ones
        if ("z", level) not in self._open:
            self._open["z", level] = (np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones).astype(np.uint32)
        return self._open["z", level]

    def _find(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) such bit of a plane for each k.

        A binary search for the block and one pass over its words; where a large part of the plane
        is asked for, all positions are listed instead.
        """
        if len(k) * 64 > self.n:
            return np.flatnonzero(np.unpackbits(self._section(2 + 2 * level, np.uint8), bitorder="little", count=self.n) == bit)[k]
        before = self._before(level, bit)
        block = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        left = k - before[block].astype(np.int64)
        words = self._words(level)
        word = block * (BLOCK // 64)
        for _ in range(BLOCK // 64 - 1):
            here = np.bitwise_count(words[word] if bit else ~words[word]).astype(np.int64)
            over = left >= here
            left = np.where(over, left - here, left)
            word = np.where(over, word + 1, word)
            if not over.any():
                break
        # A later word is not tried once one holds the bit: rows that stay are tried again, to no effect.
        bits = np.unpackbits((words[word] if bit else ~words[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)

    def accesses(self, at: np.ndarray) -> np.ndarray:
        """Tokens at those positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not (at.min() >= 0 and at.max() < self.n):
            raise IndexError("a position beyond the shard")
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits if len(at) else 0):
            bit, ones = self._bits(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def access(self, i: int) -> int:
        """Token at position i."""
        return int(self.accesses(np.array([i]))[0])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's run starts below the last plane, and its end for the first i positions."""
        at = np.array([0, i])
        for level in range(self.bits):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return int(at[0]), int(at[1])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def selects(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of the token."""
        k, total = np.asarray(k, np.int64), self.count(token)
        if len(k) and not (k.min() >= 0 and k.max() < total):
            raise IndexError("fewer occurrences than that")
        at = self._range(token, self.n)[0] + k if len(k) else k
        for level in range(self.bits - 1, -1, -1) if len(k) else ():
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token, in time that grows with the logarithm of the shard."""
        return int(self.selects(token, np.array([k]))[0])

    def occurrences(self, token: int) -> list[int]:
        return self.selects(token, np.arange(self.count(token))).tolist()

    def tokens(self) -> np.ndarray:
        """All ids in order; expands the planes from the lowest up."""
        x = np.zeros(self.n, np.int64)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._section(2 + 2 * level, np.uint8), bitorder="little", count=self.n).astype(bool)
            low, x = x, np.zeros(self.n, np.int64)
            x[~one] = low[: self.zeros[level]]
            x[one] = low[self.zeros[level] :] | 1 << (self.bits - 1 - level)
        return x

    def document(self, k: int) -> list[int]:
        """Ids of the k-th document of the shard."""
        return self.accesses(np.arange(int(self.offsets[k]), int(self.offsets[k + 1]))).tolist()


SCHEMA = "shard_id long, n_docs int, n_tokens long, doc_ids array<long>, file binary"


def token_shards(docs: DataFrame, ranks_path: str = RANKS, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each shard: its documents and its file.

    Documents stand in the order of doc_id, null ones last, then of the text's key; shard_id rises
    in that order, with gaps.  A shard is closed when it holds shard_tokens tokens, and before each
    document whose key has a hash divisible by shard_docs; so shards are the same however rows are
    spread over files, are as large at any input size, and a very long document is a shard of its
    own at most.  A null or empty text is a document without tokens; a null doc_id stays null;
    repeated rows are documents each; an empty table gives no shard; further columns are left out,
    whatever their names.
    """
    ranks = load_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, numbers = coder(ranks.value), Numbers()
        bits = int(max(bpe.ranks.values())).bit_length()
        small = np.uint16 if bits <= 16 else np.uint32
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        now, part, total, made = -1, -1, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, names, sizes, total, made
            joined = np.concatenate(ids) if ids else np.zeros(0, small)
            blob = pack(joined, names, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), bits)
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([len(names)], pa.int32()), pa.array([total]), pa.array([names], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["shard_id", "n_docs", "n_tokens", "doc_ids", "file"])
            ids, names, sizes, total, made = [], [], [], 0, made + 1
            return out

        for batch in slices(batches, limit=2 * SLICE_BYTES):
            offsets, got = bpe.encode_all(pc.fill_null(batch.column("text"), ""))
            got, n, number = got.astype(small), np.diff(offsets), numbers.of(batch)
            doc_ids = batch.column("doc_id").to_pylist()
            far = np.append(np.flatnonzero(number[1:] != number[:-1]) + 1, len(number))
            at = 0
            while at < len(n):
                if number[at] != now:
                    if names:
                        yield close()
                    now = int(number[at])
                    if now >> 32 != part:
                        part, made = now >> 32, 0
                stop = int(far[np.searchsorted(far, at, side="right")])
                stop = min(stop, at + int(np.searchsorted(np.cumsum(n[at:stop]), shard_tokens - total)) + 1)
                ids.append(got[offsets[at] : offsets[stop]])
                names += doc_ids[at:stop]
                sizes += n[at:stop].tolist()
                total += int(n[at:stop].sum())
                at = stop
                if total >= shard_tokens:
                    yield close()
        if names:
            yield close()

    return in_order(docs, shard_docs).mapInArrow(run, SCHEMA)


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(shard_id, token, n): how often each token occurs in each shard, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard_id").to_pylist(), batch.column("file").to_pylist(), strict=True):
                matrix = WaveletMatrix(blob)
                yield pa.RecordBatch.from_pydict({"shard_id": [shard] * len(tokens), "token": tokens, "n": [matrix.count(t) for t in tokens]})

    return shards.select("shard_id", "file").mapInArrow(run, "shard_id long, token long, n long")


def save(shards: DataFrame, folder: str) -> None:
    """Writes one file for each shard, by Spark, to a folder of any file system that it knows; the matrix is compressed already."""
    shards.write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder; documents and numbers are read without the matrices where those are not asked for."""
    return spark.read.schema(SCHEMA).parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))
