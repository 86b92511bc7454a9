"""Order-preserving packing of documents into windows of fixed length by dynamic programming.

Tokens are those of byte-level BPE (ngramforge.llm.bpe).  Windows follow each other in document
order and are cut at ends of documents or sentences.  A window costs the tokens that pad it, plus a
penalty where its cut truncates a document after a sentence, and a larger one within a sentence of
more tokens than a window has (such sentences are split to pieces of a window's length, the only
cuts inside a sentence).  With S the tokens before a cut, least(j) = min over i with S_j - S_i <=
length of least(i) + S_i, plus length - S_j and the penalty at j; the minimum over the sliding range
comes from a monotone queue, so a shard takes time in proportion to its sentences.  No token is
dropped.

Documents are packed by shards of SHARD_DOCS on average, whatever their ids are
(ngramforge.llm.ranges).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ngramforge.llm.bpe import RANKS, coder, load_ranks
from ngramforge.llm.common import give_back, slices, table
from ngramforge.llm.ranges import Numbers, in_order

#: Tokens of a window.
LENGTH = 2048
#: Cost of a cut within a document, and of one within a sentence, in tokens of padding.
SENTENCE_CUT = 16
INNER_CUT = 256
#: Mean number of documents that are packed together; shards are independent.
SHARD_DOCS = 1024

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
#: Full stops of Chinese end a sentence by themselves, the ellipsis where white space follows.
_WIDE, _DOTS = ("。", "！", "？"), ("…",)


def _behind(data: np.ndarray, at: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """Whether one of the marks, of three bytes each, ends before each place."""
    out = np.zeros(len(at), bool)
    some = np.flatnonzero(at >= 3)
    for mark in marks:
        a, b, c = mark.encode()
        out[some] |= (data[at[some] - 3] == a) & (data[at[some] - 2] == b) & (data[at[some] - 1] == c)
    return out


def sentence_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places behind the sentences of texts of UTF-8 that follow each other: behind white space that holds a line break or follows a full stop, and behind a full stop of Chinese."""
    if not len(data):
        return np.zeros(0, np.int64)
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    blank = _BLANK[data]
    starts = np.flatnonzero(blank & (~np.append(False, blank[:-1]) | border[:-1]))
    stops = np.flatnonzero(blank & (~np.append(blank[1:], False) | border[1:])) + 1
    breaks = np.add.reduceat((data == 10).astype(np.int32), starts) > 0 if len(starts) else np.zeros(0, bool)
    marked = ~border[starts] & (_STOP[data[starts - 1]] | _behind(data, starts, _WIDE + _DOTS))
    # The last byte of each mark is no start of a character, so few places are looked at twice.
    wide = np.flatnonzero(np.isin(data, np.array([m.encode()[2] for m in _WIDE], np.uint8)) & ~np.append(blank[1:] & ~border[1:-1], False)) + 1
    return np.sort(np.concatenate((stops[breaks | marked], wide[_behind(data, wide, _WIDE)])))


def units_of(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, held: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, tokens, end in the text, penalty of a cut there) of each sentence or piece of one of many texts, which follow each other.

    offsets: where each text starts, and the end; ends: where each token ends; held: the tokens
    before each text, and in all.  A sentence ends with the last token that ends a character in it,
    as a blank may be the next word's; a piece has length tokens, or less by those of a character
    that would be cut.
    """
    whole = np.append((data[ends[:-1]] & 0xC0) != 0x80, True) if len(ends) else np.zeros(0, bool)
    # The last token, by number from 1, of each prefix that ends with a whole character.
    safe = np.maximum.accumulate(np.where(np.append(True, whole), np.arange(len(ends) + 1), 0))
    stops = np.unique(np.concatenate((held, safe[np.searchsorted(ends, sentence_ends(data, offsets), side="right")])))
    sizes = np.diff(stops, prepend=0)
    stops, sizes = stops[sizes > 0], sizes[sizes > 0]
    costs = np.full(len(stops), SENTENCE_CUT)
    long = np.flatnonzero(sizes > length)
    if len(long):
        pieces = []
        for stop, size in zip(stops[long].tolist(), sizes[long].tolist(), strict=True):
            at = int(safe[stop - size + length])
            while at < stop:
                pieces.append(at)
                at = int(safe[at + length]) if stop - at > length else stop
        stops = np.sort(np.concatenate((stops, np.array(pieces, np.int64))))
        costs = np.where(np.isin(stops, pieces), INNER_CUT, SENTENCE_CUT)
        sizes = np.diff(stops, prepend=0)
    costs[np.isin(stops, held)] = 0
    text = np.searchsorted(held, stops, side="left") - 1
    return text, sizes, ends[stops - 1] - offsets[text] if len(stops) else stops, costs


def units(text: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """units_of() one text."""
    return units_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ends, np.array([0, len(ends)]), length)[1:]


def cuts(sizes: list[int], penalties: list[int], length: int) -> list[int]:
    """Ends of the windows, as numbers of units, at the least total cost; ties go to the longest last window."""
    total, least, back = [0], [0], [0]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (least + total, cut), rising
    for j, (size, penalty) in enumerate(zip(sizes, penalties, strict=True), 1):
        s = total[-1] + size
        total.append(s)
        while total[queue[0][1]] < s - length:
            queue.popleft()
        best, i = queue[0]
        cost = best + length - s + penalty
        least.append(cost)
        back.append(i)
        key = cost + s
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(sizes)
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


SCHEMA = "shard long, window int, n_tokens int, padding int, doc_ids array<long>, texts array<string>"
_ARROW = pa.schema([("shard", pa.int64()), ("window", pa.int32()), ("n_tokens", pa.int32()), ("padding", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


class Shard:
    """The documents of one shard, in order."""

    def __init__(self, number: int, length: int):
        self.number, self.length = number, length
        self.ids: list[int | None] = []
        self.texts: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: list[int | None], texts: list[bytes], owner: np.ndarray, sizes: np.ndarray, ends: np.ndarray, costs: np.ndarray) -> None:
        """More documents, with their units; owner: the number of each unit's document among them."""
        self.parts.append((owner + len(self.ids), sizes, ends, costs))
        self.ids += ids
        self.texts += texts

    def windows(self) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in _ARROW.names}
        if self.ids:
            owner, sizes, ends, costs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            owner = owner.tolist()
            total, ends, at = np.append(0, np.cumsum(sizes)), ends.tolist(), 0
            for number, stop in enumerate(cuts(sizes.tolist(), costs.tolist(), self.length)):
                ids, texts, i = [], [], at
                while i < stop:
                    k, j = owner[i], i
                    while j < stop and owner[j] == k:
                        j += 1
                    ids.append(self.ids[k])
                    texts.append(self.texts[k][ends[i - 1] if i and owner[i - 1] == k else 0 : ends[j - 1]].decode())
                    i = j
                n = int(total[stop] - total[at])
                for name, value in zip(out, (self.number, number, n, self.length - n, ids, texts), strict=True):
                    out[name].append(value)
                at = stop
        return pa.RecordBatch.from_pydict(out, schema=_ARROW)


def pack(docs: DataFrame, length: int = LENGTH, shard_docs: int = SHARD_DOCS, ranks_path: str = RANKS) -> DataFrame:
    """Windows of at most length tokens over docs in the order of doc_id.

    Returns (shard, window, n_tokens, padding, doc_ids, texts): the documents of a window and the
    part of each that stands in it; shards and their windows are numbered in the order of the
    documents, shards with gaps.  Texts are shuffled once, to ranges of the order.  Null and empty
    texts and ones of nothing but white space have no part in any window; rows with a null doc_id
    come last, in the order of their texts' keys; rows that repeat a doc_id are packed each, in the
    order of their texts' keys; rows equal in both are of one shard; an empty table gives no rows;
    a text of any length is packed whole, also one without blanks; all further columns are left
    out, whatever their names.
    """
    if length < 4:
        raise ValueError("a window holds the tokens of any character, which may be four")
    ranks = load_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, numbers = coder(ranks.value), Numbers()
        shard = None
        for batch in slices(batches):
            flat = batch.column("text").cast(pa.large_binary())
            held, ids = bpe.encode_all(batch.column("text"))
            begin = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            data = np.frombuffer(flat.buffers()[2], np.uint8)[begin[0] : begin[-1]]
            owner, *rest = units_of(data, begin - begin[0], np.cumsum(bpe.size[ids]), held, length)
            texts, doc_ids, number = flat.to_pylist(), batch.column("doc_id").to_pylist(), numbers.of(batch)
            edges = np.concatenate(([0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if shard is None or number[a] != shard.number:
                    if shard:
                        yield shard.windows()
                    shard = Shard(int(number[a]), length)
                lo, hi = np.searchsorted(owner, [a, b])
                shard.add(doc_ids[a:b], texts[a:b], owner[lo:hi] - a, *(x[lo:hi] for x in rest))
        if shard:
            yield shard.windows()
        shard = None
        bpe.forget()
        give_back()

    return in_order(docs.where(F.col("text").rlike(r"\S")), shard_docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
