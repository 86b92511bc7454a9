"""Near-duplicate removal with order MinHash.

A text is the sequence of its words, in lower case and without punctuation around them.  Its k-mers
(runs of K words) are labelled with how often each stood before, so that repeats differ.  Each of
SAMPLES hash functions picks the ORDER labelled k-mers of least hash; their k-mers in text order
are the sample.  Texts that agree in a sample are likely to be close in edit distance, not only in
content.  The texts that share a sample are linked to the one of them that shares most samples with
others; each link is then verified by a banded alignment of the words.  Texts of a sample that the
components of the links leave apart are compared in two further rounds, near ones in the order of
length and then all others: histograms of their hashed words bound the edit distance from below,
and the pairs that this bound does not rule out are aligned.  So each two texts of a sample are in
one group, were aligned, or cannot be similar.  The groups are the connected components of all
links that hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.llm.common import U64, column, content, cut, group_bounds, mix, second, segment_ids, slices, table, unused, whole_groups, words
from ngramforge.llm.components import components
from ngramforge.llm.fingerprint import normal

K = 3
#: At a similarity of SIMILARITY by scattered words about 27 % of k-mers are common, and samples agree at about that share to the power of ORDER.
ORDER = 2
SAMPLES = 64
#: Least similarity of two texts of a group: 1 - edit distance in words by the longer length.
SIMILARITY = 0.75
#: Cells of the histogram of a text's words, and the most that a cell counts.
CELLS = 256
FULL = 255
#: Places in a sample's order of length within which texts are compared first, and texts that a task compares with as many others.
NEAR = 64
BLOCK = 2048
#: Half the width of the first band that is tried.
BAND = 512
#: Positions times words from which the positions of a word are found when needed, not kept.
PATTERN_BITS = 1 << 29
#: Bits of a hash that give way to the position in the text; longer texts take what they need.
POSITION_BITS = 24


def kmers(offsets: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of each text's k-mers; a shorter text has one of all its words."""
    size = np.diff(offsets)
    n = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(n)))
    start = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], n)
    end = np.repeat(offsets[1:], n)
    padded = np.concatenate((hashes, np.zeros(k, U64)))
    value = np.zeros(len(start), U64)
    for i in range(k):
        value = mix(value + np.where(start + i < end, padded[start + i], U64(0)) + U64(i + 1))
    return out, value


def labels(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each value stood before in its text."""
    text = segment_ids(offsets)
    order = np.lexsort((values, text))
    a, b = values[order], text[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(a), np.int64)
    out[order] = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return out


def sketches(offsets: np.ndarray, hashes: np.ndarray, k: int = K, order: int = ORDER, samples: int = SAMPLES, seed: int = 1) -> np.ndarray:
    """(text, samples): the samples as 64-bit values; 0 for a text without words."""
    offs, value = kmers(offsets, hashes, k)
    out = np.zeros((len(offsets) - 1, samples), U64)
    some = np.flatnonzero(np.diff(offs))
    if not len(some):
        return out
    labelled = mix(value ^ mix(labels(offs, value).astype(U64)))
    starts, n = offs[:-1][some], np.diff(offs)[some]
    position = (np.arange(offs[-1]) - np.repeat(starts, n)).astype(U64)
    low = U64((1 << max(POSITION_BITS, int(n.max()).bit_length())) - 1)
    spread = np.empty_like(value)
    for s in range(samples):
        salt = mix(np.array([seed * 1_000_003 + s + 1], U64))[0] | U64(1)
        # The finaliser's first half is enough here: labelled values are mixed, and only the order counts.
        np.multiply(labelled, salt, out=spread)
        spread ^= spread >> U64(32)
        spread *= U64(0xD6E8FEB86659FD93)
        spread &= ~low
        spread |= position
        picks = []
        for i in range(order):
            least = np.minimum.reduceat(spread, starts)
            at = (least & low).astype(np.int64)
            at = np.where(n > i, at, -1)
            picks.append(at)
            spread[starts[at >= 0] + at[at >= 0]] = U64(0xFFFFFFFFFFFFFFFF)
        found = np.sort(np.stack(picks, axis=1), axis=1)
        sample = np.full(len(some), s + 1, U64)
        for i in range(order):
            at = found[:, i]
            sample = mix(sample * U64(3) + np.where(at >= 0, value[starts + np.maximum(at, 0)], U64(7)))
        out[some, s] = sample
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of sequences, or its limit + 1 where it is larger.

    Equal ends are cut off, pairs whose multisets differ too much are out, and the rest is aligned
    within a band around the diagonal that widens up to the limit.
    """
    out = np.zeros(len(pairs), np.int64)
    for p, (a, b) in enumerate(pairs):
        limit = int(limits[p])
        m = min(len(a), len(b))
        same = a[:m] == b[:m]
        lo = m if same.all() else int(same.argmin())
        a, b = a[lo:], b[lo:]
        m = min(len(a), len(b))
        if m:
            same = a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
            hi = m if same.all() else int(same.argmin())
            a, b = a[: len(a) - hi], b[: len(b) - hi]
        if not len(a) or not len(b):
            out[p] = min(len(a) + len(b), limit + 1)
            continue
        every, code = np.unique(np.concatenate((a, b)), return_inverse=True)
        count = np.bincount(code[: len(a)], minlength=len(every)) - np.bincount(code[len(a) :], minlength=len(every))
        least = int(max(count[count > 0].sum(), -count[count < 0].sum()))
        band = max(least, BAND)
        while least <= limit:
            band = min(band, limit)
            found = banded(code[: len(a)], code[len(a) :], band)
            if found <= band or band == limit:
                least = found
                break
            band *= 4
        out[p] = min(least, limit + 1)
    return out


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two sequences of codes, exact where at most band, else above it.

    Bit-parallel: bit t of a column of the table is the row band - t above the diagonal, and the
    vectors hold where neighbouring cells differ by one.  The band moves down a row with each column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    width = 2 * band + 1
    mask = (1 << width) - 1
    up = (mask >> band) << band
    down = 0
    row = min(band, n)
    score, far = row, 2 * band + m - n
    sparse = n * (len(set(a.tolist())) // 16) > PATTERN_BITS
    where: dict[int, int] = {}
    if not sparse:
        for i, c in enumerate(a.tolist()):
            where[c] = where.get(c, 0) | 1 << i
    top = 1 << (width - 1)
    for j, c in enumerate(b.tolist()):
        lo = j - band
        if sparse:
            part = int.from_bytes(np.packbits(a[max(lo, 0) : j + band + 1] == c, bitorder="little").tobytes(), "little")
            x = part << -lo if lo < 0 else part
        else:
            x = where.get(c, 0)
            x = (x >> lo if lo >= 0 else x << -lo) & mask
        same = ((((x & up) + up) & mask) ^ up) | x | down
        over = down | (mask ^ (same | up))
        under = same & up
        if row < n:  # down the last diagonal of the band, which never falls
            row += 1
            if not same & top:
                score += 1
                if score > far:
                    return band + 1
        else:
            bit = 1 << (n - 1 - lo)
            if over & bit:
                score += 1
            elif under & bit:
                score -= 1
        same >>= 1
        up = under | (mask ^ (same | over))
        down = same & over
    return score if score <= band else band + 1


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return words(part.column("text"), normal)


def _whole_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sample, node, n) in order, without repeated ones and those whose sample no other node has; holds one row between batches."""
    last: pa.Table | None = None
    open_ = False  # whether the row held is one of several of its sample
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([last, rows]).combine_chunks() if last is not None else rows
        sample, node = rows.column("sample").to_numpy(), rows.column("node").to_numpy()
        once = np.append(True, (sample[1:] != sample[:-1]) | (node[1:] != node[:-1]))
        rows, sample = rows.filter(pa.array(once)), sample[once]
        same = np.append(open_, sample[1:] == sample[:-1])
        keep = same | np.append(same[1:], False)
        last, open_ = rows.slice(len(sample) - 1), bool(same[-1])
        out = rows.slice(0, len(sample) - 1).filter(pa.array(keep[:-1]))
        yield from out.to_batches()
    if last is not None and open_:
        yield from last.to_batches()


def buckets(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(sample, node, n): the content keys of the texts that share a sample, with their number of words.

    A task gives each text that it meets once, so that equal texts don't crowd a sample; those of
    several tasks meet in the order of the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in slices(batches):
            names = part.column("node").to_pylist()
            new = []
            for x in names:
                new.append(x not in met)
                met.add(x)
            part = part.filter(pa.array(new, pa.bool_()))
            offsets, hashes = _tokens(part)
            sketch = sketches(offsets, hashes, samples=samples)
            size = np.diff(offsets)
            some = np.flatnonzero(size)
            keys = part.column("node").to_numpy(zero_copy_only=False)[some]
            yield pa.RecordBatch.from_arrays([pa.array(sketch[some].reshape(-1).view(np.int64)), pa.array(np.repeat(keys, samples)), pa.array(np.repeat(size[some], samples).astype(np.int32))], names=["sample", "node", "n"])

    kind = "sample long, node long, n int"
    rows = docs.where("text IS NOT NULL").select(content().alias("node"), "text").mapInArrow(run, kind)
    return rows.repartition("sample").sortWithinPartitions("sample", "n", "node").mapInArrow(_whole_samples, kind)


def encoded(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, words, cells): the word hashes of each text of shared, and their histogram; of texts that have one key the one of least second key."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, hashes = _tokens(part)
            short = (hashes >> U64(32)).astype(np.uint32)
            held = [short[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            cells = histograms(offsets, short)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(held, pa.binary()), pa.array([x.tobytes() for x in cells], pa.binary())], names=["node", "words", "cells"])

    texts = docs.where("text IS NOT NULL").select(content().alias("node"), "text", second().alias("other"))
    of = texts.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min_by("text", "other").alias("text"))
    return of.mapInArrow(encode, "node long, words binary, cells binary")


def histograms(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(text, CELLS): how many of each text's words fall in each cell, FULL at most."""
    n = len(offsets) - 1
    flat = segment_ids(offsets) * CELLS + (hashes % np.uint32(CELLS)).astype(np.int64)
    return np.minimum(np.bincount(flat, minlength=n * CELLS).reshape(n, CELLS), FULL).astype(np.uint8)


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts of those histograms and lengths may be similar: each edit makes up for one word that either has more of, at most one each way."""
    x, y = a.astype(np.int16), b.astype(np.int16)
    over = np.maximum(x - y, 0).sum(axis=1, dtype=np.int64)
    under = np.maximum(y - x, 0).sum(axis=1, dtype=np.int64)
    return np.maximum(over, under) <= limit_of(n, m, similarity)


def limit_of(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The largest edit distance of similar texts of n and m words."""
    return np.floor((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)


def verified(held: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are that similar by banded alignment; held: encoded()."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a few MB at a time
                part = batch.slice(at, 512)
                at += 512
                own = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(part.column("wa").to_pylist(), part.column("wb").to_pylist(), strict=True)]
                longest = np.array([max(len(x), len(y)) for x, y in own])
                limits = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
                ok = pa.array(distances(own, limits) <= limits)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], names=["a", "b"])

    first = pairs.join(held.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    both = first.join(held.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(align, "a long, b long")


def _pairs(linked: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of linked (node, n, other, m) whose lengths alone don't rule them out."""
    near = F.abs(F.col("n") - F.col("m")) <= F.floor(F.lit(1 - similarity) * F.greatest("n", "m") + F.lit(1e-9))
    return linked.where((F.col("node") != F.col("other")) & near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def stars(shared: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of each text to the one of its sample that meets most texts over all samples, as the original of many copies does."""
    sized = shared.join(shared.groupBy("sample").agg(F.count("*").alias("held")), "sample")
    weighed = shared.join(sized.groupBy("node").agg(F.sum("held").alias("weight")), "node")
    central = weighed.groupBy("sample").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("other"), F.col("n").alias("m"))).alias("c"))
    return _pairs(shared.join(central, "sample").select("node", "n", "c.other", "c.m"), similarity)


def apart(shared: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """(sample, node, n, root, cells, at, rows) of the samples whose texts are of several groups; at: the place in the order of length, from 0; rows: how many they are."""
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("sample").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).where("low <> high").select("sample", "rows")
    few = rooted.join(mixed, "sample")
    order = Window.partitionBy("sample").orderBy("n", "node")
    placed = few.withColumn("at", F.row_number().over(order) - 1)
    return placed.join(held.select("node", "cells"), "node")


def across(mixed: DataFrame, low: int, high: int | None, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of texts of a sample and of different groups that stand low to high - 1 places from each other and may be similar; mixed: apart().

    A sample of more than BLOCK texts is compared block by block, two of them in a task at a time.
    """
    far = f"(rows - 1) div {BLOCK}" if high is None else f"least((rows - 1) div {BLOCK}, at div {BLOCK} + {-(-(high - 1) // BLOCK)})"
    near = 0 if high is None else -(-(high - 1) // BLOCK)
    first = "0" if high is None else f"greatest(0, at div {BLOCK} - {near})"
    rows = mixed.where(f"rows > {low}").withColumn("own", F.expr(f"at div {BLOCK}")).withColumn("to", F.explode(F.expr(f"sequence({first}, {far})")))
    rows = rows.select("sample", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"), "own", "at", "node", "n", "root", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["sample", "x", "y"]):
            sample, x, y, own, at, node, n, root = (part.column(c).to_numpy() for c in ("sample", "x", "y", "own", "at", "node", "n", "root"))
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(node), CELLS)
            a, b = [], []
            edges = group_bounds(sample, x, y)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                # The rows of the first block, each with those further on in the order of length.
                ends = hi if x[lo] == y[lo] else lo + int(np.searchsorted(own[lo:hi], y[lo]))
                reach = np.floor(n[lo:ends] / similarity + 1e-6)
                stop = lo + np.searchsorted(n[lo:hi], reach, side="right")
                if high is not None:
                    stop = np.minimum(stop, lo + np.searchsorted(at[lo:hi], at[lo:ends] + high))
                begin = np.maximum(lo + np.searchsorted(at[lo:hi], at[lo:ends] + low), ends if x[lo] != y[lo] else 0)
                for i, f, e in zip(range(lo, ends), begin.tolist(), stop.tolist(), strict=True):
                    if f >= e:
                        continue
                    other = np.flatnonzero(root[f:e] != root[i]) + f
                    other = other[possible(cells[other], cells[i : i + 1], n[other], n[i : i + 1], similarity)] if len(other) else other
                    a.append(np.full(len(other), node[i])), b.append(node[other])
            if a:
                one, two = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return rows.repartition("sample", "x", "y").sortWithinPartitions("sample", "x", "y", "at").mapInArrow(run, "a long, b long").distinct()


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of roots after further edges (a, b)."""
    of = edges
    for end in ("a", "b"):
        of = of.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    over = components(cut(of.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()))
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(moved.unionByName(over.join(roots, "node", "left_anti")))


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the group of each content key that has a near duplicate among the texts it shares a sample with, or theirs."""
    shared = cut(buckets(docs))
    held = cut(encoded(docs, shared))
    tried = cut(stars(shared, similarity))
    roots = components(cut(verified(held, tried, similarity)))
    for low, high in ((1, NEAR), (NEAR, None)):
        pairs = cut(across(apart(shared, roots, held), low, high, similarity).join(tried, ["a", "b"], "left_anti"))
        edges = cut(verified(held, pairs, similarity))
        if not edges.isEmpty():
            roots = joined(roots, edges)
    return roots


def keepers(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, other, doc_id, copies, keeper, size) for each distinct row (text, doc_id) with a text.

    node and other are the text's two keys, of 64 bits each; texts are equal where both are.  Of
    texts that share node only the one of least other was compared; the rest, which are not to be
    expected, are left alone but for their own copies.  keeper is the (doc_id, node, other) that
    stays of its group: the least doc_id, a null one last, then the least keys.  copies counts the
    rows alike; size counts the rows of the group.
    """
    rows = docs.where("text IS NOT NULL").groupBy(content().alias("node"), second().alias("other"), "doc_id").agg(F.count("*").alias("copies"))
    texts = rows.groupBy("node").agg(F.min("other").alias("least")).join(groups(docs, similarity), "node", "left")
    compared = F.col("other") == F.col("least")
    grouped = rows.join(texts, "node").withColumn("own", F.when(compared, F.lit(0)).otherwise(F.col("other"))).withColumn("root", F.when(compared, F.coalesce("root", "node")).otherwise(F.col("node")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"), F.col("other").alias("other"))
    best = grouped.groupBy("root", "own").agg(F.min(order).alias("keeper"), F.sum("copies").alias("size"))
    return grouped.join(best, ["root", "own"]).select("node", "other", "doc_id", "copies", F.struct("keeper.doc_id", "keeper.node", "keeper.other").alias("keeper"), "size")


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("node") == F.col("keeper.node")) & (F.col("other") == F.col("keeper.other"))


def duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows that are exact or near copies and not the one that stays.

    Returns (doc_id, kept_doc_id, group_size), a row for each row of docs removed.  A null text is
    no copy of anything; empty texts, and texts that differ only in case and punctuation around
    words, are copies; texts without any word are copies only where equal.  A text without white
    space is one word.  Of rows that repeat all but one are removed; a null doc_id is one like
    others, kept last; the least doc_id of a group stays; an empty table gives no rows; a text of
    any length is compared whole; further columns are left out.
    """
    found = keepers(docs.select("doc_id", "text"), similarity)
    gone = found.withColumn("n", F.col("copies") - _stays().cast("int")).where("n > 0")
    return gone.select("doc_id", F.col("keeper.doc_id").alias("kept_doc_id"), F.col("size").alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that duplicates() names; all columns stay.

    The keys of the rows that go are joined by content and doc_id, which moves documents once, or
    twice where rows repeat.  Of rows equal in both the one whose other columns hash least stays.
    """
    found = keepers(docs.select("doc_id", "text"), similarity).where("size > 1")
    node, other, doc, copies, first = unused(docs, "_node", "_other", "_doc", "_copies", "_stays")
    marks = cut(found.select(F.col("node").alias(node), F.col("other").alias(other), F.col("doc_id").alias(doc), F.col("copies").alias(copies), _stays().alias(first)))
    here = (content(docs["text"]) == F.col(node)) & (second(docs["text"]) == F.col(other)) & docs["doc_id"].eqNullSafe(F.col(doc)) & docs["text"].isNotNull()
    kept = docs.join(marks.where(f"NOT {first} OR {copies} > 1"), here, "left_anti")
    repeated = marks.where(f"{first} AND {copies} > 1")
    if repeated.isEmpty():
        return kept
    plain = [column(c) for c, kind in docs.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    tie = Window.partitionBy(node, other, doc).orderBy(F.xxhash64(*plain))
    one = docs.join(repeated, here).withColumn(first, F.row_number().over(tie)).where(f"{first} = 1")
    return kept.unionByName(one.select(*[column(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
