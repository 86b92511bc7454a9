"""Counts, entropies and variations of a corpus, from one shuffle of its windows.

Each place of a sentence gives one window: the tokens from there on, as many as the longest n-gram
has.  All n-grams that begin with the same two tokens are prefixes of windows that begin with them,
so one task counts them from those windows, sorted; an n-gram isn't moved once for each length.
Windows travel as columns of token numbers, compressed, with the tokens they use beside them: a
block from each task to each other.  Tasks hold the windows of one part; there are as many parts as
the input's size asks for, so what a task holds does not grow with the input.  A list of tokens from
a sample goes to all tasks, and blocks hold only the tokens that are not on it: else the more parts
there are, the more blocks repeat the same tokens.

For the measures the token in front of a window goes along.  Windows are then parted by their first
token, and by the first two where the first is one of the few frequent ones: what is continued and
what is preceded by what is counted where the n-gram itself is.  Only the shorter n-gram to the
right, of which a backward variation is taken, is elsewhere; one more shuffle, of n-grams with their
entropies, brings both together.  Of the frequent tokens and the empty n-gram the parts add up,
a row for each of them and each part.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ngramforge.functions.keys import MARKERS, SEP

#: Tokens that a task gathers before it sends their windows on.
TOKENS = 3_000_000
#: Bytes of the input's files for each part.
PART_BYTES = 16_000_000
#: Numbers that n-grams asked for fall on; a table of all of them is still broadcast.
BUCKETS = 1 << 18
#: Rows of a batch that is given out.
ROWS = 50_000
#: Share of all tokens from which on a token is frequent.
FREQUENT = 0.002
#: Sentences of a sample, the tokens of each that are looked at, and the most tokens that are known everywhere.
SEEN, SEEN_TOKENS, KNOWN = 20_000, 200, 60_000
BLOCKS = "p int, size int, data binary"
COUNTED = "k int, ngram string, count long, back_count long"

Batches = Iterator[pa.RecordBatch]


def read_bytes(rows: DataFrame) -> tuple[int, bool]:
    """Bytes of the tables that rows are of, as far as Spark knows, and whether it knows all."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    # A table whose size Spark doesn't know counts as one beyond all bounds there.
    known = [s for s in sizes if s < 1 << 50]
    return sum(known), len(known) == len(sizes)


def parts_of(rows: DataFrame) -> int:
    """Parts for the windows of rows: as Spark's setting has it, more if the files read are large."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), read_bytes(rows)[0] // PART_BYTES)


def narrowed(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Those rows of known (k, ngram) that may be among asked (k, ngram), for a join of both.

    Only where asked is of far smaller tables: then the n-grams asked for fall on few of BUCKETS
    numbers, and what falls on none of these is not moved. All rows that meet one asked for stay.
    """
    (few, sure), (many, _) = read_bytes(asked), read_bytes(known)
    if not sure or few * 10 > many:
        return known
    bucket = F.pmod(F.xxhash64(F.col("k").cast("int"), F.col("ngram")), F.lit(BUCKETS))
    return known.withColumn("_bucket", bucket).join(F.broadcast(asked.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")


# Columns of token numbers: 0 is no token, others are one more than the place in the dictionary


def _hashes(tokens: pa.Array) -> np.ndarray:
    """A number for each token that depends on its bytes alone."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4).astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[place])])
    return _mixed(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + size.astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, both: np.ndarray, parts: int) -> np.ndarray:
    """Part of n-grams that begin with a and b; only a counts where both is false or there is no b. hashes and both: by token number."""
    second = np.where(both[a], hashes[b], np.uint64(0))
    return (_mixed(hashes[a] + second * np.uint64(3)) % np.uint64(parts)).astype(np.int64)


def _keys(columns: list[np.ndarray], limits: list[int]) -> list[np.ndarray]:
    """The columns, whose values are below limits, as few numbers of 63 bits each in the same order."""
    out: list[np.ndarray] = []
    room = 0
    for column, limit in zip(columns, limits, strict=True):
        bits = max(1, int(limit - 1).bit_length())
        if bits > room:
            out.append(column.astype(np.int64))
            room = 63 - bits
        else:
            out[-1] = (out[-1] << bits) | column
            room -= bits
    return out


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted keys differ from those before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _totals(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers added up by place."""
    if len(values) and int(values.max()) * len(values) < 1 << 52:
        return np.bincount(at, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def _small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max))


# Blocks


def _planes(values: object) -> object:
    """Arrays as (type, bytes), all first bytes of their numbers before all second ones, which compresses better; others as they are."""
    if isinstance(values, np.ndarray):
        wide = values.dtype.itemsize
        return values.dtype.str, np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T).tobytes() if wide > 1 else values.tobytes()
    return [_planes(v) for v in values] if isinstance(values, list) else values


def _array(planes: tuple[str, bytes]) -> np.ndarray:
    kind, data = np.dtype(planes[0]), np.frombuffer(planes[1], np.uint8)
    return np.ascontiguousarray(data.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _arrays(planes: object) -> object:
    if isinstance(planes, tuple):
        return _array(planes)
    return [_arrays(v) for v in planes] if isinstance(planes, list) else planes


class _Sender:
    """Makes blocks of columns of token numbers; the first of its tokens, of which there are known, have the same number everywhere."""

    def __init__(self, tokens: pa.Array, known: int):
        self.tokens, self.known = tokens, known
        self.number = np.arange(len(tokens) + 1)

    def block(self, columns: list[np.ndarray], *others: object) -> tuple[int, bytes]:
        """Size and bytes of the columns, with the tokens that they use, and others."""
        used = np.zeros(len(self.number), bool)
        for column in columns:
            used[column] = True
        places = np.flatnonzero(used[self.known + 1 :]) + self.known + 1
        self.number[places] = np.arange(self.known + 1, self.known + 1 + len(places))
        tokens = self.tokens.take(pa.array(places - 1))
        ends = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4) if len(tokens) else np.zeros(1, np.int32)
        text = tokens.buffers()[2][ends[0] : ends[-1]].to_pybytes() if ends[-1] > ends[0] else b""
        data = pickle.dumps((_planes(_small(np.diff(ends))), text, [_planes(_small(self.number[c])) for c in columns], [_planes(o) for o in others]), protocol=5)
        return len(data), pa.compress(data, codec="zstd", asbytes=True)


def _sorted_tokens(known: pa.Array, tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens, known ones first as they are and the rest in order, and the numbers of tokens by those."""
    coded = pa.concat_arrays([known, tokens.cast(pa.string())]).dictionary_encode()
    rest = coded.dictionary[len(known) :]
    order = pc.sort_indices(rest).to_numpy().astype(np.int64)
    number = np.arange(1, len(coded.dictionary) + 1, dtype=np.int32)
    number[len(known) + order] = np.arange(len(known) + 1, len(number) + 1)
    return pa.concat_arrays([known, rest.take(pa.array(order))]), number[coded.indices.to_numpy()[len(known) :]]


def _batch(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    p, size, data = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["p", "size", "data"])


def _sent(blocks: Iterator[tuple[int, int, bytes]]) -> Batches:
    held, size = [], 0
    for block in blocks:
        held.append(block)
        size += len(block[2])
        if size > 4 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _received(batches: Batches, known: pa.Array) -> tuple[pa.Array, list[list[np.ndarray]], list[list]]:
    """The tokens of all blocks, known ones first, and for each block its columns by those and the rest of it."""
    dictionaries, columns, others = [], [], []
    for batch in batches:
        for size, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
            sizes, text, numbers, other = pickle.loads(pa.decompress(data.as_buffer(), size, codec="zstd", asbytes=True))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(_array(sizes), dtype=np.int32)])
            dictionaries.append(pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]))
            columns.append(_arrays(numbers)), others.append(_arrays(other))
    if not dictionaries:
        return pa.array([], pa.string()), [], []
    coded = pa.concat_arrays([known, *dictionaries]).dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int32) + 1
    own = np.arange(len(known) + 1, dtype=np.int32)
    at = len(known)
    for i, tokens in enumerate(dictionaries):
        number = np.concatenate([own, places[at : at + len(tokens)]])
        at += len(tokens)
        columns[i] = [number[c] for c in columns[i]]
    return coded.dictionary, columns, others


def _windows(length: int, parts: int, known: pa.Array, front: bool = False, frequent: pa.Array | None = None, stage: int = 0) -> Callable[[Batches], Batches]:
    """From padded sentences to blocks of windows. front: with the token before each; frequent: tokens whose windows are parted by the second one too, all where None; stage: goes along."""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        lists = pa.concat_arrays([b.column("tokens") for b in held])
        freq, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("freq", "n"))
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        tokens, ids = _sorted_tokens(known, lists.flatten())
        sender, most = _Sender(tokens, len(known)), len(tokens) + 1
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(len(ids))
        first, last = np.zeros(len(ids), bool), left == 1
        first[end - size] = True
        weight, longest = np.repeat(freq, size), np.repeat(n, size)
        single = [_totals(ids[mask], weight[mask], most) for mask in (~last, ~first)]
        root = int((freq * (size - 1)).sum())
        kept = np.flatnonzero((left > 1) & (longest > 1)) if length > 1 else np.zeros(0, np.int64)
        columns = []
        for j in range(length if len(kept) else 0):
            there = (left[kept] > j) & (longest[kept] > j)
            columns.append(np.where(there, ids[np.minimum(kept + j, len(ids) - 1)], 0))
        if front and columns:
            columns.append(np.where(first[kept], 0, ids[kept - 1]))
        hashes = np.concatenate([np.zeros(1, np.uint64), _hashes(tokens)])
        both = np.ones(most, bool) if frequent is None else np.concatenate([[False], pc.is_in(tokens, frequent).to_numpy(zero_copy_only=False)])
        own = _parts(hashes, np.arange(most), np.zeros(most, np.int64), np.zeros(most, bool), parts)
        seen = np.flatnonzero((single[0] > 0) | (single[1] > 0))
        singles = seen[np.argsort(own[seen], kind="stable")]
        single_ends = np.searchsorted(own[singles], np.arange(parts + 1))
        if columns:
            p = _parts(hashes, columns[0], columns[1], both, parts)
            keys = _keys([p, *columns], [parts, *[most] * len(columns)])
            order = _order(keys)
            starts = np.flatnonzero(_changes([key[order] for key in keys]))
            times = _added(weight[kept][order], starts)
            order = order[starts]
            columns, p = [c[order] for c in columns], p[order]
            ends = np.searchsorted(p, np.arange(parts + 1))
        for i in range(parts):
            mine = singles[single_ends[i] : single_ends[i + 1]]
            part = [c[ends[i] : ends[i + 1]] for c in columns]
            if i and not len(mine) and not (part and len(part[0])):
                continue
            counted = _small(times[ends[i] : ends[i + 1]]) if part else None
            yield i, *sender.block([mine, *part], [_small(s[mine]) for s in single], counted, 0 if i else root, stage)

    def run(batches: Batches) -> Batches:
        held, many = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += len(batch.column("tokens").flatten())
            if many >= TOKENS:
                yield from _sent(blocks(held))
                held, many = [], 0
        if held:
            yield from _sent(blocks(held))

    return run


class _Part:
    """The windows of one part, sorted: columns t (the first token's first, the one in front last if it is there) and times."""

    def __init__(self, received: tuple[pa.Array, list[list[np.ndarray]], list[list]], length: int, front: bool = False):
        self.tokens, columns, others = received
        self.most, self.length = len(self.tokens) + 1, length
        self.root = sum(o[2] for o in others)
        self.any = any(o[2] for o in others)
        self.single = [_totals(np.concatenate([c[0] for c in columns]), np.concatenate([o[0][side].astype(np.int64) for o in others]), self.most) if others else np.zeros(1, np.int64) for side in (0, 1)]
        full = [i for i, o in enumerate(others) if o[1] is not None]
        width = length + front
        t = [np.concatenate([columns[i][1 + j] for i in full]) for j in range(width)] if full else [np.zeros(0, np.int32)] * width
        times = np.concatenate([others[i][1].astype(np.int64) for i in full]) if full else np.zeros(0, np.int64)
        del columns, others
        order = _order(_keys(t[:length], [self.most] * length))
        self.t, self.times = [c[order] for c in t], times[order]

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, group of each window, first window and times of each group) for each length; groups without a k-th token are no n-grams."""
        changed = np.zeros(len(self.times), bool)
        for k in range(1, self.length + 1):
            changed = changed | _changes([self.t[k - 1]])
            starts = np.flatnonzero(changed)
            yield k, np.cumsum(changed) - 1, starts, _added(self.times, starts)

    def names(self, columns: list[np.ndarray]) -> pa.Array:
        return _names(self.tokens, columns)


def _names(tokens: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The keys of n-grams, all of one length."""
    taken = [tokens.take(pa.array(c - 1)) for c in columns]
    return taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, SEP)


def _given(names: list[str], parts: int, k: int, name: Callable[[slice], pa.Array], *columns: np.ndarray) -> Batches:
    """Batches of (k, ngram, columns); NaN is null. parts: how many rows there are."""
    for at in range(0, parts, ROWS):
        cut = slice(at, at + ROWS)
        own = [pa.array(c[cut], from_pandas=c.dtype.kind == "f") for c in columns]
        ngram = name(cut)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ngram), k, np.int32)), ngram, *own], names=["k", "ngram", *names])


def _count(length: int, known: pa.Array) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        part = _Part(_received(batches, known), length)
        give = lambda k, columns, *values: _given(["count", "back_count"], len(values[0]), k, lambda cut: part.names([c[cut] for c in columns]), *values)
        if part.any:
            yield from _given(["count", "back_count"], 1, 0, lambda _: pa.array([""]), np.array([part.root]), np.array([part.root]))
        some = np.flatnonzero((part.single[0] > 0) | (part.single[1] > 0))
        yield from give(1, [some], part.single[0][some], part.single[1][some])
        for k, _, starts, times in part.depths():
            if k > 1:
                real = part.t[k - 1][starts] > 0
                at, times = starts[real], times[real]
                yield from give(k, [c[at] for c in part.t[:k]], times, times)

    return run


class Sample(NamedTuple):
    """Tokens of a sample: those that repeat in it, and those that may be frequent, with the markers. Neither decides on a result."""

    known: pa.Array
    frequent: pa.Array


def sample(padded: DataFrame) -> Sample:
    """Of the first sentences, as many as SEEN and as far as SEEN_TOKENS of each.

    Which tokens are frequent decides only which windows share a part; which are known only how many
    bytes blocks take.
    """
    seen = Counter(t for row in padded.select(F.slice("tokens", 1, SEEN_TOKENS).alias("tokens")).take(SEEN) for t in row.tokens)
    least = FREQUENT * seen.total()
    known = [t for t, n in seen.most_common(KNOWN) if n > 1]
    return Sample(pa.array(known, pa.string()), pa.array(sorted({*MARKERS, *(t for t, n in seen.items() if n >= least)}), pa.string()))


def known_tokens(padded: DataFrame) -> pa.Array:
    """Those of sample(), none where the tables are small or their rows come out of a shuffle, which a sample would repeat."""
    plan = padded._jdf.queryExecution().optimizedPlan().toString()
    small = read_bytes(padded)[0] < PART_BYTES or "Aggregate" in plan or "Join" in plan
    return pa.array([], pa.string()) if small else sample(padded).known


def sent(padded: DataFrame, length: int, parts: int, known: pa.Array, front: bool = False, frequent: pa.Array | None = None) -> DataFrame:
    """Blocks of windows of padded sentences, each part in its own task."""
    return padded.mapInArrow(_windows(length, parts, known, front, frequent), BLOCKS).repartitionById(parts, "p")


def count(padded: DataFrame, length: int) -> DataFrame:
    """(k, ngram, count, back_count) of padded sentences with n-grams of up to length."""
    known = known_tokens(padded)
    return sent(padded, length, parts_of(padded), known).mapInArrow(_count(length, known), COUNTED)


# Counts of several corpora and models

#: Rows of counts that a task gathers before it sends them on.
STORED = 1_000_000


def _stored(parts: int, known: pa.Array, stage: int) -> Callable[[Batches], Batches]:
    """From counts to blocks of their n-grams, to the parts where _windows() puts the same n-grams."""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        table = pa.Table.from_batches(held)
        for k in pc.unique(table["k"]).to_pylist():
            rows = table.filter(pc.equal(table["k"], k)).combine_chunks()
            count_, back = (pc.fill_null(rows[c], 0).to_numpy() for c in ("count", "back_count"))
            values = [count_, back, pc.is_valid(rows["back_count"]).to_numpy().astype(np.int64)]
            if k == 0:
                yield from _dealt_out(_Sender(known, len(known)), np.zeros(len(count_), np.int64), 0, [], values, parts, stage)
                continue
            names = rows["ngram"].combine_chunks()
            names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
            tokens, ids = _sorted_tokens(known, pc.split_pattern(names, SEP).flatten() if k > 1 else names)
            columns = list(ids.reshape(-1, k).T)
            hashes = np.concatenate([np.zeros(1, np.uint64), _hashes(tokens)])
            to = _parts(hashes, columns[0], columns[min(k, 2) - 1], np.full(len(hashes), k > 1), parts)
            yield from _dealt_out(_Sender(tokens, len(known)), to, k, columns, values, parts, stage)

    def run(batches: Batches) -> Batches:
        held, many = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= STORED:
                yield from _sent(blocks(held))
                held, many = [], 0
        if held:
            yield from _sent(blocks(held))

    return run


def _folded(known: pa.Array, taken: list[int | None], lengths: list[int]) -> Callable[[Batches], Batches]:
    """Counts of a part after all stages: each adds what came with its number, then takes so many from every count, nothing where that is None. lengths: of the windows of each stage."""

    def run(batches: Batches) -> Batches:
        tokens, columns, others = _received(batches, known)
        most = len(tokens) + 1
        # By length: (columns, count, back_count, whether back_count is known, stage), each without repetitions but for stored ones.
        found: dict[int, list[tuple]] = {}
        windows: dict[tuple[int, int], list[int]] = {}
        for i, o in enumerate(others):
            if isinstance(o[0], int):
                count_, back, some = (v.astype(np.int64) for v in o[1])
                found.setdefault(o[0], []).append((columns[i], count_, back, some, o[2], False))
            else:
                windows.setdefault((o[3], lengths[o[3]]), []).append(i)
        for (stage, length), own in windows.items():
            part = _Part((tokens, [columns[i] for i in own], [others[i] for i in own]), length)
            if part.any:
                found.setdefault(0, []).append(([], np.array([part.root]), np.array([part.root]), np.ones(1, np.int64), stage, True))
            some = np.flatnonzero((part.single[0] > 0) | (part.single[1] > 0))
            found.setdefault(1, []).append(([some], part.single[0][some], part.single[1][some], np.ones(len(some), np.int64), stage, True))
            for k, _, starts, times in part.depths():
                if k > 1:
                    real = part.t[k - 1][starts] > 0
                    at, times = starts[real], times[real]
                    found.setdefault(k, []).append(([c[at] for c in part.t[:k]], times, times, np.ones(len(at), np.int64), stage, True))
        del columns, others, windows
        for k in sorted(found):
            pieces = found.pop(k)
            t = [np.concatenate([p[0][j] for p in pieces]) for j in range(k)]
            count_, back, some = (np.concatenate([p[j] for p in pieces]) for j in (1, 2, 3))
            at = np.repeat([p[4] for p in pieces], [len(p[1]) for p in pieces])
            if len(pieces) == 1 and pieces[0][5]:
                group = first = np.arange(len(count_))
            elif k == 0:
                group, first = np.zeros(len(count_), np.int64), np.zeros(1, np.int64)
            else:
                keys = _keys(t, [most] * k)
                order = _order(keys)
                changed = _changes([key[order] for key in keys])
                group, first = np.empty(len(order), np.int64), order[changed]
                group[order] = np.cumsum(changed) - 1
            c, b, known_back = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
            for stage in range(len(taken) + 1):
                rows = np.flatnonzero(at == stage)
                if len(rows):
                    c += _totals(group[rows], count_[rows], len(first))
                    b += _totals(group[rows], back[rows], len(first))
                    known_back |= np.bincount(group[rows], some[rows], len(first)) > 0
                if k and stage < len(taken) and taken[stage] is not None:
                    c, b = np.maximum(c - taken[stage], 0), np.maximum(b - taken[stage], 0)
                    known_back[:] = True
            kept = np.flatnonzero((c > 0) | (b > 0)) if k and any(q is not None for q in taken) else np.arange(len(first))
            for lo in range(0, len(kept), ROWS):
                rows = kept[lo : lo + ROWS]
                ngram = _names(tokens, [x[first[rows]] for x in t]) if k else pa.array([""] * len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), ngram, pa.array(c[rows]), pa.array(b[rows], mask=~known_back[rows])], names=["k", "ngram", "count", "back_count"])

    return run


def folded(steps: Sequence[tuple]) -> DataFrame:
    """Counts after steps, in their order: ("sentences", padded, longest n-gram) and ("counts", counts) add, ("prune", q) takes as counts.prune() does.

    Windows and n-grams of counts meet in their parts, in one shuffle of all.
    """
    taken: list[int | None] = []
    added: list[tuple[int, tuple]] = []
    lengths: list[int] = []
    for step in steps:
        if step[0] == "prune":
            taken.append(step[1])
        else:
            # Windows of other lengths are another stage, which takes nothing before it.
            if step[0] == "sentences" and len(lengths) > len(taken) and lengths[len(taken)] not in (0, step[2]):
                taken.append(None)
            lengths += [0] * (len(taken) + 1 - len(lengths))
            if step[0] == "sentences":
                lengths[len(taken)] = step[2]
            added.append((len(taken), step))
    frames = [step[1] for _, step in added]
    spark = frames[0].sparkSession
    sizes = [read_bytes(f)[0] for f in frames]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes) // PART_BYTES)
    texts = [i for i, (_, step) in enumerate(added) if step[0] == "sentences"]
    known = known_tokens(frames[max(texts, key=sizes.__getitem__)]) if texts else pa.array([], pa.string())
    out = None
    for stage, step in added:
        if step[0] == "sentences":
            blocks = step[1].mapInArrow(_windows(step[2], parts, known, stage=stage), BLOCKS)
        else:
            own = step[1].select(F.col("k").cast("int"), F.col("ngram").cast("string"), F.col("count").cast("long"), F.col("back_count").cast("long"))
            blocks = own.mapInArrow(_stored(parts, known, stage), BLOCKS)
        out = blocks if out is None else out.unionByName(blocks)
    return out.repartitionById(parts, "p").mapInArrow(_folded(known, taken, lengths), COUNTED)


# Leaves, and what is pruned from them upwards

LEAVES, LEAFWISE, HAPAX = "leaves", "leafwise", "hapax"


def _trimmed(length: int, of: Sample, rule: str, q: int, top: bool) -> Callable[[Batches], Batches]:
    """(k, ngram, n, kept) by that rule. top: what a part adds to the empty n-gram and the frequent tokens; else its other n-grams, that stay."""

    def run(batches: Batches) -> Batches:
        part = _Part(_received(batches, of.known), length)
        if not len(part.times):
            return
        levels, place = [], None
        for k, group, starts, times in part.depths():
            real = part.t[k - 1][starts] > 0
            at = starts[real]
            levels.append((at, times[real], place[at] if k > 1 else np.zeros(len(at), np.int64)))
            place = (np.cumsum(real) - 1)[group]
        lost, children = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for k in range(length, 0, -1):
            at, n, _ = levels[k - 1]
            below = _totals(children, lost, len(at))
            leaf = np.bincount(children, minlength=len(at)) == 0
            own = np.where(leaf, np.minimum(n, q), below) if rule == LEAFWISE else below
            stays = leaf if rule == LEAVES else (n > 1) & (n > own) if rule == HAPAX else n > own
            out.append((k, at, n, n - own if rule != LEAVES else n, stays))
            # What the n-gram above loses by this one.
            lost, children = np.where(n == 1, 1, own) if rule == HAPAX else own, levels[k - 1][2]
        frequent_ = np.concatenate([[False], pc.is_in(part.tokens, of.frequent).to_numpy(zero_copy_only=False)])
        names = ["n", "kept"]
        give = lambda k, at, *values: _given(names, len(at), k, lambda cut: part.names([c[at[cut]] for c in part.t[:k]]), *values)
        k, at, n, kept, stays = out.pop()
        many = frequent_[part.t[0][at]]
        if top:
            yield from _given(names, 1, 0, lambda _: pa.array([""]), np.array([n.sum()]), np.array([kept.sum()]))
            yield from give(1, at[many], n[many], kept[many])
            return
        out.append((k, at, n, kept, stays & ~many))
        for k, at, n, kept, stays in out:
            yield from give(k, at[stays], n[stays], kept[stays])

    return run


def trimmed(padded: DataFrame, length: int, rule: str, q: int = 1) -> DataFrame:
    """(k, ngram, count) of a corpus with n-grams of one length from 2 on, read forwards: counts.leaves(), prune_leaves() or prune_hapax() of its counts.

    What goes is a matter of n-grams with the same two first tokens, as windows are parted; of the
    empty n-gram and the frequent tokens the parts add up.
    """
    of = sample(padded)
    blocks = sent(padded, length, parts_of(padded), of.known, frequent=of.frequent)
    schema = "k int, ngram string, n long, kept long"
    rows = blocks.mapInArrow(_trimmed(length, of, rule, q, False), schema)
    if rule != LEAVES:  # a token that a window begins with is no leaf
        tops = blocks.mapInArrow(_trimmed(length, of, rule, q, True), schema).groupBy("k", "ngram").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
        rows = rows.unionByName(tops.where(f"k = 0 OR (kept > 0 AND n > {1 if rule == HAPAX else 0})"))
    return rows.select("k", "ngram", F.col("kept").alias("count"))


# Measures

MEASURED = "k int, ngram string, count long, h double, above double, top string, back_h double, back_above double, back_top string"
TOPS = "k int, ngram string, back boolean, n long, q double, children long, ends boolean"


class _Measured(_Part):
    """A part with the token in front of each window, and which of its tokens are frequent or markers."""

    def __init__(self, batches: Batches, length: int, tokens: Sample):
        super().__init__(_received(batches, tokens.known), length, True)
        held = lambda values: np.concatenate([[False], pc.is_in(self.tokens, values).to_numpy(zero_copy_only=False)])
        self.many, self.marker = held(tokens.frequent), held(pa.array(MARKERS, pa.string()))

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, group of each window, first window and times of each group, entropy in both directions) below the full length.

        The entropy is NaN where nothing follows, or stands before. What a frequent token has is a part of it only.
        """
        depths = self.depths()
        before = next(depths)
        for after in depths:
            k, group, starts, times = before
            _, _, next_starts, next_times = after
            real = self.t[k][next_starts] > 0
            at = next_starts[real]
            forwards = _entropy(group[at], next_times[real], self.marker[self.t[k][at]], len(starts))
            front = self.t[self.length]
            rows = np.flatnonzero(front > 0)
            key = group[rows] * self.most + front[rows]
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(_changes([key]))
            backwards = _entropy(key[first] // self.most, _added(self.times[rows][order], first), self.marker[key[first] % self.most], len(starts))
            yield k, group, starts, times, forwards, backwards
            before = after


    def ngrams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, first window, times, entropy, that of the n-gram without the last token, entropy backwards, whether it is settled here) of the n-grams of levels(), without the frequent tokens.

        Settled are those of three tokens on that occur once, begin with no marker and have no
        variation forwards: they have no autonomy, and _lone() has what they add to the means.
        """
        shorter = None
        for k, group, starts, all_times, all_h, all_back in self.levels():
            rows = np.flatnonzero(self.t[k - 1][starts] > 0 if k > 1 else ~self.many[self.t[0][starts]])
            at, times, h, back = starts[rows], all_times[rows], all_h[rows], all_back[rows]
            above = np.full(len(at), np.nan) if k == 1 else shorter[0][shorter[1][at]]
            if k == 2:
                above[self.many[self.t[0][at]]] = np.nan
            settled = (k > 2) & (times == 1) & ~self.marker[self.t[0][at]] & (np.isnan(h) | ((h == 0) & (above == 0)))
            yield k, at, times, h, above, back, settled
            shorter = all_h, group


def _sums(at: np.ndarray, c: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Children's total, sum of c log2 c over those that are no marker, number, and whether one is a marker, by parent."""
    q = np.where(ends, 0.0, c * np.log2(np.maximum(c, 1)))
    return _totals(at, c, size), np.bincount(at, q, size), np.bincount(at, minlength=size), np.bincount(at, ends, size) > 0


def _entropy(at: np.ndarray, c: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    n, q, children, some = _sums(at, c, ends, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.log2(n) - q / n
    h[(n == 1) | ((children == 1) & ~some)] = 0.0
    h[children == 0] = np.nan
    return h


def _tops(length: int, of: Sample) -> Callable[[Batches], Batches]:
    """What a part adds to the entropies of the empty n-gram and of the frequent tokens."""
    names = ["back", "n", "q", "children", "ends"]

    def run(batches: Batches) -> Batches:
        part = _Measured(batches, length, of)
        for back, single in enumerate(part.single):
            own = np.flatnonzero(single)
            if len(own):
                sums = _sums(np.zeros(len(own), np.int64), single[own], part.marker[own], 1)
                yield from _given(names, 1, 0, lambda _: pa.array([""]), np.array([bool(back)]), *sums)
        for k, _, starts, times in part.depths():
            if k != 2:
                continue
            pair = part.t[1][starts] > 0
            a, b, c = part.t[0][starts[pair]], part.t[1][starts[pair]], times[pair]
            for back, (own, child) in enumerate(((a, b), (b, a))):
                rows = part.many[own]
                sums = _sums(own[rows], c[rows], part.marker[child[rows]], part.most)
                some = np.flatnonzero(sums[2])
                yield from _given(names, len(some), 1, lambda cut, some=some: part.names([some[cut]]), np.full(len(some), bool(back)), *(s[some] for s in sums))
            return

    return run


def _entropies(length: int, of: Sample) -> Callable[[Batches], Batches]:
    """(k, ngram, h, back_h) of the n-grams of a part, without the frequent tokens."""

    def run(batches: Batches) -> Batches:
        part = _Measured(batches, length, of)
        for k, _, starts, _, h, back in part.levels():
            rows = part.t[k - 1][starts] > 0 if k > 1 else ~part.many[part.t[0][starts]]
            at = starts[rows]
            yield from _given(["h", "back_h"], len(at), k, lambda cut, k=k, at=at: part.names([c[at[cut]] for c in part.t[:k]]), h[rows], back[rows])

    return run


def _dealt_out(sender: _Sender, to: np.ndarray, k: int, columns: list[np.ndarray], values: list[np.ndarray], parts: int, *more: object) -> Iterator[tuple[int, int, bytes]]:
    """A block for each part that rows go to: k, columns, values and more."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(ends)).tolist():
        rows = order[ends[i] : ends[i + 1]]
        yield i, *sender.block([c[rows] for c in columns], k, [_small(v[rows]) if v.dtype.kind == "i" else v[rows] for v in values], *more)


def _asked(length: int, parts: int, of: Sample) -> Callable[[Batches], Batches]:
    """From windows to blocks of n-grams with their entropies: to where the n-gram without its first token is, and those that others may be without their first token to their own part."""

    def blocks(part: _Measured) -> Iterator[tuple[int, int, bytes]]:
        hashes = np.concatenate([np.zeros(1, np.uint64), _hashes(part.tokens)])
        sender = _Sender(part.tokens, len(of.known))
        for k, at, times, h, above, back, settled in part.ngrams():
            columns = [c[at] for c in part.t[:k]]
            none = np.zeros(len(at), np.int32)
            own = _parts(hashes, columns[0], columns[1] if k > 1 else none, part.many, parts)
            # Of single tokens and of those that end with a frequent one the shorter one is at the top.
            to = own if k == 1 else _parts(hashes, columns[1], columns[2] if k > 2 else none, part.many, parts)
            if k == 2:
                to = np.where(part.many[columns[1]], own, to)
            moved = ~settled
            yield from _dealt_out(sender, to[moved], k, [c[moved] for c in columns], [v[moved] for v in (times, h, above, back)], parts)
            if k <= length - 2:
                # What ends with an n-gram that occurs once occurs once, so that neither has an entropy other than 0.
                some = times > 1
                yield from _dealt_out(sender, own[some], -k, [c[some] for c in columns], [back[some]], parts)

    def run(batches: Batches) -> Batches:
        part = _Measured(batches, length, of)
        if len(part.times):
            yield from _sent(blocks(part))

    return run


def _settled(length: int, of: Sample) -> Callable[[Batches], Batches]:
    """(k, ngram) of the settled n-grams that go on in both directions."""

    def run(batches: Batches) -> Batches:
        part = _Measured(batches, length, of)
        for k, at, _, h, _, back, settled in part.ngrams():
            at = at[settled & ~np.isnan(h) & ~np.isnan(back)]
            yield from _given([], len(at), k, lambda cut, k=k, at=at: part.names([c[at[cut]] for c in part.t[:k]]))

    return run


def _lone(length: int, of: Sample) -> Callable[[Batches], Batches]:
    """(k, n, mean, m2) of the backward variations of all n-grams of three tokens on that occur once and begin with no marker.

    They are counted with the n-gram without their first token, which is here; their own entropy is 0.
    """

    def run(batches: Batches) -> Batches:
        part = _Measured(batches, length, of)
        front = part.t[length]
        for k, group, starts, _, _, back in part.levels():
            if not 2 <= k <= length - 2:
                continue
            rows = np.flatnonzero((front > 0) & ~part.marker[front] & (part.t[k - 1] > 0))
            key = group[rows] * part.most + front[rows]
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(_changes([key]))
            once = _added(part.times[rows][order], first) == 1
            ev = -back[key[first][once] // part.most]
            ev = ev[ev != 0]
            if len(ev):
                mean = ev.mean()
                row = [np.array([k + 1], np.int32), np.array([len(ev)]), np.array([mean]), np.array([((ev - mean) ** 2).sum()])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["k", "n", "mean", "m2"])

    return run


def _answered(length: int, of: Sample) -> Callable[[Batches], Batches]:
    """MEASURED of the n-grams of blocks; above is NULL and top the shorter n-gram where that is at the top."""
    names = ["count", "h", "above", "top", "back_h", "back_above", "back_top"]

    def run(batches: Batches) -> Batches:
        tokens, columns, others = _received(batches, of.known)
        frequent_ = np.concatenate([[False], pc.is_in(tokens, of.frequent).to_numpy(zero_copy_only=False)])
        most = len(tokens) + 1

        def gathered(k: int) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
            own = [i for i, o in enumerate(others) if o[0] == k]
            if not own:
                return None
            return [np.concatenate([columns[i][j] for i in own]) for j in range(abs(k))], [np.concatenate([others[i][1][v] for i in own]) for v in range(len(others[own[0]][1]))]

        for k in range(1, length):
            found = gathered(k)
            if found is None:
                continue
            t, (times, h, above, back) = found
            back_above = np.full(len(times), np.nan)
            known = gathered(1 - k) if k > 1 else None
            if known is not None:
                keys = _keys([np.concatenate([a, b]) for a, b in zip(known[0], t[1:], strict=True)], [most] * (k - 1))
                order = _order(keys)
                group = np.empty(len(order), np.int64)
                group[order] = np.cumsum(_changes([key[order] for key in keys])) - 1
                value = np.full(len(order), np.nan)
                many_known = len(known[1][0])
                value[group[:many_known]] = known[1][0]
                back_above = value[group[many_known:]]
            no = pa.nulls(1, pa.string())
            for at in range(0, len(times), ROWS):
                cut = slice(at, at + ROWS)
                own = [c[cut] for c in t]
                size = len(own[0])
                if k == 1:
                    top = back_top = pa.array([""] * size)
                elif k == 2:
                    top, back_top = (pc.if_else(pa.array(frequent_[c]), _names(tokens, [c]), no[0]) for c in own)
                else:
                    top = back_top = pa.nulls(size, pa.string())
                floats = [pa.array(v[cut], from_pandas=True) for v in (h, above, back, back_above)]
                arrays = [pa.array(times[cut].astype(np.int64)), floats[0], floats[1], top, floats[2], floats[3], back_top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), _names(tokens, own), *arrays], names=["k", "ngram", *names])

    return run


class Corpus:
    """Entropies, variations and measures of a corpus of (tokens, freq), planned from its windows."""

    def __init__(self, padded: DataFrame, length: int):
        self.length = length
        self.of = sample(padded)
        self.parts = parts_of(padded)
        self.blocks = sent(padded, length, self.parts, self.of.known, True, self.of.frequent)

    def tops(self) -> DataFrame:
        """(k, ngram, count, h, back_h) of the empty n-gram and the frequent tokens, of which there are a bounded number."""
        sums = self.blocks.mapInArrow(_tops(self.length, self.of), TOPS).groupBy("k", "ngram", "back").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("children").alias("children"), F.max("ends").alias("ends"))
        zero = (F.col("n") == 1) | ((F.col("children") == 1) & ~F.col("ends"))
        h = F.when(zero, 0.0).otherwise(F.log2("n") - F.col("q") / F.col("n"))
        side = lambda value, back: F.max(F.when(F.col("back") == back, value))
        out = sums.groupBy("k", "ngram").agg(side(F.col("n"), False).alias("count"), side(h, False).alias("h"), side(h, True).alias("back_h"))
        return out if self.length > 1 else out.where("k = 0")

    def both(self) -> DataFrame:
        """(k, ngram, h, back_h): the entropies of both directions, known where the n-gram is counted."""
        return self.blocks.mapInArrow(_entropies(self.length, self.of), "k int, ngram string, h double, back_h double").unionByName(self.tops().drop("count"))

    def entropies(self) -> DataFrame:
        """(back, k, ngram, entropy) as stats.entropies() of the counts."""
        rows = self.both()
        sides = F.array(*(F.struct(F.lit(back).alias("back"), "k", "ngram", F.col(h).alias("entropy")) for back, h in ((False, "h"), (True, "back_h"))))
        return rows.select(F.explode(sides).alias("s")).select("s.*").where("entropy IS NOT NULL")

    def varied(self) -> DataFrame:
        """(k, ngram, count, h, ev, back_h, back_ev) of every n-gram with children in a direction, the empty one included.

        Settled ones are there if they have children in both, and without back_ev.
        """
        asked = self.blocks.mapInArrow(_asked(self.length, self.parts, self.of), BLOCKS).repartitionById(self.parts, "p")
        rows = asked.mapInArrow(_answered(self.length, self.of), MEASURED)
        null = lambda kind: F.lit(None).cast(kind)
        tops = self.tops()
        own = tops.select("k", "ngram", "count", "h", null("double").alias("above"), F.when(F.col("k") == 1, "").alias("top"), "back_h", null("double").alias("back_above"), F.when(F.col("k") == 1, "").alias("back_top"))
        at = lambda top, h: F.broadcast(tops.where(f"{h} IS NOT NULL").select(F.col("k").alias(f"{top}_k"), F.col("ngram").alias(f"{top}_ngram"), F.col(h).alias(f"{top}_h")))
        out = rows.unionByName(own)
        for top, h in (("top", "h"), ("back_top", "back_h")):
            out = out.join(at(top, h), (F.col(top) == F.col(f"{top}_ngram")) & (F.col("k") - 1 == F.col(f"{top}_k")), "left")
        ev = lambda h, above: F.when((F.col(h) != 0) | (above != 0), F.col(h) - above)
        out = out.select("k", "ngram", "count", "h", ev("h", F.coalesce("above", "top_h")).alias("ev"), "back_h", ev("back_h", F.coalesce("back_above", "back_top_h")).alias("back_ev"))
        if self.length < 4:
            return out
        settled = self.blocks.mapInArrow(_settled(self.length, self.of), "k int, ngram string")
        zero = F.lit(0.0)
        return out.unionByName(settled.select("k", "ngram", F.lit(1).cast("long").alias("count"), zero.alias("h"), null("double").alias("ev"), zero.alias("back_h"), null("double").alias("back_ev")))

    def lone(self) -> DataFrame | None:
        """(k, n, mean, m2): by part, the backward variations of those n-grams whose rows in varied() don't count for the means backwards, of which some lack it; None where all rows count."""
        return None if self.length < 4 else self.blocks.mapInArrow(_lone(self.length, self.of), "k int, n long, mean double, m2 double")
