"""Byte-level BPE by monoid tree reduction.

A text is halved until its pieces are short; pieces are encoded alone, and two neighbours are
joined by encoding a window around their boundary anew.  The window grows to both sides until it
ends at positions where the pre-tokenizer is bound to cut whatever stands further out: a
character other than white space before a blank or line break, or an ASCII letter before an ASCII
character that is neither letter nor blank.  No match of the pattern spans such a position and the
pattern looks no further back, so the tokens outside of the window are those of the joined text.
Joining is associative; decoding concatenates byte strings up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ngramforge.llm.common import SLICE_BYTES, list_array, ragged_take, slices, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece that is encoded without being halved.
LEAF_CHARS = 8192
#: Words whose tokens a worker remembers.
CACHE_WORDS = 500_000

SYNC = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[!-&(-/0-9:-@\[-`{-~])")
#: White space before a blank: cutting at blanks alone would then differ from the pattern.
SPACED = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


class ByteBPE:
    """Encodes and decodes with one vocabulary; ranks is the content of a rank file."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.base = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.size = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.forget()

    def flat(self, text: str) -> np.ndarray:
        return np.array(self.base.encode_ordinary(text), np.int32)

    def forget(self) -> None:
        """Drops the words remembered."""
        self.known: dict[str, int] = {}
        self.ends, self.flat_ids, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _remember(self, pieces: list[str]) -> np.ndarray:
        """Where each piece's tokens are: slot i has flat_ids[ends[i]:ends[i + 1]].

        New pieces that a blank starts are encoded in one go, the others alone.
        """
        if len(self.known) > CACHE_WORDS:
            self.forget()
        known = self.known
        slots = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(slots < 0)]
        if not new:
            return slots
        # Only the first character is white space.
        led = [len(x) > 1 and x[0] == " " and len(x.strip()) == len(x) - 1 for x in new]
        joint, alone = list(compress(new, led)), [x for x, a in zip(new, led, strict=True) if not a]
        ids = np.frombuffer(self.base._core_bpe.encode_to_tiktoken_buffer("".join(joint), set()), np.uint32).astype(np.int32)
        far = np.cumsum(np.fromiter(map(len, map(str.encode, joint)), np.int64, len(joint)))
        ends = np.searchsorted(np.cumsum(self.size[ids]), far, side="right")
        rest = [self.flat(x) for x in alone]
        ends = np.concatenate((ends, len(ids) + np.cumsum([len(x) for x in rest], dtype=np.int64))).astype(np.int64)
        ids = np.concatenate((ids, *rest))
        base, more = self.ends[self.used], len(ends)
        while len(self.ends) < self.used + more + 1:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while len(self.flat_ids) < base + len(ids):
            self.flat_ids = np.concatenate((self.flat_ids, np.zeros_like(self.flat_ids)))
        self.ends[self.used + 1 : self.used + more + 1] = base + ends
        self.flat_ids[base : base + len(ids)] = ids
        known.update(zip(joint + alone, range(self.used, self.used + more), strict=True))
        self.used += more
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> np.ndarray:
        """Token ids of a text, by halving."""
        return self.reduce(text, [self.flat(text[a:b]) for a, b in leaves(len(text), leaf)], leaf)

    def reduce(self, text: str, parts: list[np.ndarray], leaf: int = LEAF_CHARS) -> np.ndarray:
        """Token ids of a text from those of its leaves."""
        return self._up(text, 0, len(text), iter(parts), leaf)

    def _up(self, text: str, lo: int, hi: int, parts: Iterator[np.ndarray], leaf: int) -> np.ndarray:
        if hi - lo <= leaf:
            return next(parts)
        mid = (lo + hi) // 2
        left = self._up(text, lo, mid, parts, leaf)
        return self.join(text, lo, mid, hi, left, self._up(text, mid, hi, parts, leaf))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b, reach = None, None, 32
        while a is None:
            start = max(lo, mid - reach)
            found = [x.start() for x in SYNC.finditer(text, start, mid)]
            found = [x for x in found if start < x < mid]
            a = found[-1] if found else lo if start == lo else None
            reach *= 2
        reach = 32
        while b is None:
            stop = min(hi, mid + reach)
            found = (x.start() for x in SYNC.finditer(text, mid, stop))
            b = next((x for x in found if mid < x < stop), hi if stop == hi else None)
            reach *= 2
        return np.concatenate((left[: self._count(left, text[lo:a])], self.flat(text[a:b]), right[self._count(right, text[mid:b]) :]))

    def _count(self, ids: np.ndarray, text: str) -> int:
        """How many of the first tokens make up the text."""
        return int(np.searchsorted(np.cumsum(self.size[ids]), len(text.encode()), side="right"))

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids; concatenates halves up the tree."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join([self.bytes[i] for i in ids[lo:hi].tolist()])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8", errors="replace")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of many texts; long ones are put together from leaves."""
        all_texts = texts.to_pylist()
        cuts = [leaves(len(t), LEAF_CHARS) for t in all_texts]
        pieces = [t[a:b] if len(c) > 1 else t for t, c in zip(all_texts, cuts, strict=True) for a, b in c]
        offsets, ids = self._pieces(pa.array(pieces, pa.large_string()))
        parts, at = [], 0
        for text, cut in zip(all_texts, cuts, strict=True):
            own = [ids[offsets[i] : offsets[i + 1]] for i in range(at, at + len(cut))]
            parts.append(own[0] if len(own) == 1 else self.reduce(text, own))
            at += len(cut)
        return np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As flat(), for many.  A blank after another character always starts a match of the pattern, so that equal words share their tokens."""
        rough = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~rough))
        split = pc.split_pattern(plain, " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = starts - starts[0]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        first = np.unique(codes[starts[:-1]])
        codes[starts[:-1]] = len(names) + np.searchsorted(first, codes[starts[:-1]])
        slots = self._remember([" " + x for x in names] + [names[i] for i in first])
        ends, flat = self.ends[: self.used + 1], self.flat_ids[: self.ends[self.used]]
        codes = slots[codes]
        words, ids = ragged_take(ends, flat, codes)
        offsets = words[starts]
        if not rough.any():
            return offsets, ids
        slow = {int(i): self.flat(t) for i, t in zip(np.flatnonzero(rough), texts.filter(pa.array(rough)).to_pylist(), strict=True)}
        fast = iter(range(len(plain)))
        parts = [slow[i] if (i in slow) else ids[offsets[j := next(fast)] : offsets[j + 1]] for i in range(len(texts))]
        return np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))), np.concatenate(parts)


def leaves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The pieces into which n characters are halved."""
    out: list[tuple[int, int]] = []

    def down(lo: int, hi: int) -> None:
        if hi - lo <= leaf:
            out.append((lo, hi))
        else:
            mid = (lo + hi) // 2
            down(lo, mid)
            down(mid, hi)

    down(0, n)
    return out


_coders: dict[int, ByteBPE] = {}


def coder(ranks: bytes) -> ByteBPE:
    """One coder a worker and vocabulary."""
    if (key := hash(ranks)) not in _coders:
        _coders[key] = ByteBPE(ranks)
    return _coders[key]


def load_ranks(spark: SparkSession, path: str = RANKS):
    """The rank file, read once by the driver and sent to the executors; its size is that of a vocabulary, whatever the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Token ids of each text and whether decoding them gives the text again.

    Returns (doc_id, n_tokens, ids, decoded_ok), a row for each row of docs; nothing is shuffled.
    A null text gives nulls, an empty one no tokens; a null doc_id stays; repeated rows and ties
    are encoded each; an empty table gives no rows; further columns are left out.
    """
    ranks = load_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value)
        for part in slices(batches, limit=2 * SLICE_BYTES):
            text = part.column("text")
            offsets, ids = bpe.encode_all(pc.fill_null(text, ""))
            null = text.is_null()
            ok = [bpe.decode(ids[a:b]) == (t or "") for a, b, t in zip(offsets[:-1], offsets[1:], text.to_pylist(), strict=True)]
            lists = list_array(offsets, ids, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pc.if_else(null, pa.scalar(None, pa.int32()), pa.array(np.diff(offsets).astype(np.int32))),
                    pc.if_else(null, pa.scalar(None, lists.type), lists),
                    pc.if_else(null, pa.scalar(None, pa.bool_()), pa.array(ok, pa.bool_())),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_ok"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, decoded_ok boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
