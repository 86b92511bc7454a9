"""Removal of repeated passages with a column-wise suffix array of many texts.

A passage is any run of PASSAGE words; it repeats where the same run stands earlier, in the order
of doc_id and position.  To bring repeats together without moving whole texts, each run names an
anchor: the k-mer of ANCHOR words with the least hash in it.  Runs that are alike name the same
anchor, and only anchors that occur twice are followed.  What the runs of an anchor can span is a
read; a key tells reads apart before any word is moved, so that of equal reads only the first is
cut out of its text, and of anchors with one key none.  Reads meet by anchor.  Each task drops what
no other read can share and sorts all suffixes of the rest column by column: every round puts one
more symbol in front of each read, by a stable sort of the Burrows-Wheeler transform so far, which
holds the symbol before each suffix; so the order of the longer suffixes, and their common prefixes,
follow from those of the shorter ones.  Neighbours in the final order that have PASSAGE words in
common form a run of equal passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.llm.common import U64, column, content, cut, mix, slices, table, unused, words

PASSAGE = 50
ANCHOR = 20
#: Reads whose suffixes are sorted together.
READS = 2048
_NO_ID = np.iinfo(np.int64).max
_WORD = re.compile(r"\S+")


def anchors(offsets: np.ndarray, hashes: np.ndarray, passage: int = PASSAGE, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors that the passages of each text name; the first of equal hashes is named."""
    n = np.diff(offsets)
    long = np.flatnonzero(n >= passage)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    value = np.zeros(len(hashes), U64)
    padded = np.concatenate((hashes, np.zeros(anchor, U64)))
    for i in range(anchor):
        value = value * U64(0x9E3779B97F4A7C15) + padded[i : i + len(hashes)]
    value = mix(value)
    # Least value of each stretch of w k-mers, with its position in the low bits, by doubling.
    w = passage - anchor + 1
    bits = U64(max(1, int(len(hashes)).bit_length()))
    order = (value >> bits << bits) | np.arange(len(hashes), dtype=U64)
    least, span = order, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    runs = n[long] - passage + 1
    ends = np.cumsum(runs)
    start = np.arange(ends[-1]) + np.repeat(offsets[:-1][long] - (ends - runs), runs)
    at = (least[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    text = np.searchsorted(offsets, at, side="right") - 1
    return text, at - offsets[text], value[at]


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo + 1 : hi + 1] for each lo and hi, lo < hi, from the minima of runs of each power of two."""
    out = values[hi]
    span = hi - lo
    wide = np.flatnonzero(span > 1)
    level = np.frexp(span[wide].astype(np.float32))[1] - 1
    run = values
    for k in range(1, int(level.max(initial=0)) + 1):
        half = 1 << (k - 1)
        run = np.minimum(run[:-half], run[half:])
        own = wide[level == k]
        out[own] = np.minimum(run[lo[own] + 1], run[hi[own] + 1 - 2 * half])
    return out


def suffix_order(symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, start, common) of all suffixes in order; symbols: a row for each read, left-aligned, above 0.

    common is the length of the prefix that a suffix shares with the one before it.  In each round
    the suffixes known so far, each with one symbol put in front, are exactly the non-empty suffixes
    of the next round: before is their Burrows-Wheeler transform, whose stable sort is the new
    order.  Two that follow each other and start alike share one symbol more than the least prefix
    shared between their tails.
    """
    n = len(size)
    every = np.arange(n, dtype=np.int32)
    size = size.astype(np.int32)
    flat = np.concatenate((symbols, np.zeros((n, 1), symbols.dtype)), axis=1).reshape(-1)
    width = symbols.shape[1] + 1
    kind = np.int16 if width < 1 << 14 else np.int32
    read, start, common = every, size, np.zeros(n, kind)
    before = np.where(start > 0, flat[read * width + np.maximum(start - 1, 0)], 0)
    for _ in range(int(size.max(initial=0))):
        going = np.flatnonzero(before)
        order = going[np.argsort(before[going], kind="stable")]
        first = before[order]
        alike = np.flatnonzero(first[1:] == first[:-1]) + 1
        shared = np.zeros(n + len(order), kind)
        shared[n + alike] = least_between(common, order[alike - 1], order[alike]) + 1
        read, start, common = np.concatenate((every, read[order])), np.concatenate((size, start[order] - 1)), shared
        before = flat[read.astype(np.int64) * width + np.where(start > 0, start - 1, width - 1)]
    return read[n:], start[n:], common[n + 1 :]


def repeats(symbols: np.ndarray, size: np.ndarray, where: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, start, earliest) of all passages of the reads.

    where[r] is the place of the read's first word in one order of all texts and positions;
    earliest is the least place of an equal passage, be it the passage itself.
    """
    read, start, common = suffix_order(symbols, size)
    # Runs of suffixes that share a passage; a shorter suffix is a run by itself.
    edge = np.flatnonzero(np.append(True, common < passage))
    place = where[read] + start
    least = np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(read))))
    whole = size[read] - start >= passage
    return read[whole], start[whole], least[whole]


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def stretch_keys(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit key of values[lo:hi] for each lo and hi, whatever lo is."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values * powers(_BASE, len(values))[:-1])))
    return mix((total[hi] - total[lo]) * powers(_BACK, len(values))[lo] + (hi - lo).astype(U64))


def earliest(words_: np.ndarray, offsets: np.ndarray, where: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, start, earliest) of the passages that more than one place of the reads holds, in order of read and start.

    Passages whose key stands once cannot repeat; of equal stretches of the others one is sorted.
    """
    size = np.diff(offsets)
    runs = np.maximum(size - passage + 1, 0)
    ends = np.cumsum(runs)
    read = np.repeat(np.arange(len(size)), runs)
    start = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - runs, runs)
    at = offsets[read] + start
    key = stretch_keys(mix(words_.astype(U64) + U64(1)), at, at + passage)
    _, code, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[code] > 1
    read, start, at, key = read[often], start[often], at[often], key[often]
    if not len(read):
        return read, start, start
    new = np.append(True, (read[1:] != read[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(read)) - 1
    place = where[read[first]] + start[first]
    # A stretch of at most two passages' length is known by its first and last one; longer ones are all sorted.
    length = last - first + passage
    own = np.where(length <= 2 * passage, U64(0), np.arange(len(first), dtype=U64) + U64(1))
    same = mix(key[first] ^ mix(key[last] ^ mix(length.astype(U64) ^ mix(own))))
    order = np.lexsort((place, same))
    lead = np.append(True, same[order][1:] != same[order][:-1])
    kind = np.empty(len(first), np.int64)
    kind[order] = np.cumsum(lead) - 1
    chosen = order[lead]
    least = np.empty(int((last - first + 1)[chosen].sum()), np.int64)
    begin = np.concatenate(([0], np.cumsum((last - first + 1)[chosen])))
    for a in range(0, len(chosen), READS):  # equal passages of different blocks meet below
        part = chosen[a : a + READS]
        width = length[part]
        index = at[first[part]][:, None] + np.arange(int(width.max()))[None, :]
        inside = np.arange(int(width.max()))[None, :] < width[:, None]
        names, code = np.unique(words_[index[inside]], return_inverse=True)
        symbols = np.zeros(inside.shape, np.uint16 if len(names) < (1 << 16) - 1 else np.uint32)
        symbols[inside] = code + 1
        r, o, found = repeats(symbols, width, place[part], passage)
        least[begin[a + r] + o] = found
    if len(chosen) > READS:
        keys = np.concatenate([key[first[c] : last[c] + 1] for c in chosen])
        _, code = np.unique(keys, return_inverse=True)
        over = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(over, code, least)
        least = over[code]
    stretch = np.cumsum(new) - 1
    return read, start, least[begin[kind[stretch]] + np.arange(len(read)) - first[stretch]]


def _places(doc: np.ndarray, node: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row in the order of doc_id, node and start, and the doc_id of each place >> 32."""
    order = np.lexsort((node, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (node[order][1:] != node[order][:-1]))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return (rank << 32) + start, doc[order][new]


def match(rows: pa.Table, passage: int = PASSAGE) -> pa.RecordBatch:
    """Repeated stretches of whole anchors' rows: by anchor and key, the read's words first, then its places in order."""
    anchor, key, node, start, size = (rows.column(c).to_numpy() for c in ("anchor", "key", "node", "start", "size"))
    doc = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
    text = rows.column("words").combine_chunks()
    head = text.is_valid().to_numpy(zero_copy_only=False)
    read = np.cumsum(head) - 1
    place, ids = _places(doc, node, start)
    lead = np.flatnonzero(head) + 1
    where = place[lead]
    held = text.filter(pa.array(head)).cast(pa.large_binary())
    raw = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    words_ = np.frombuffer(held.buffers()[2], np.uint8)[raw[0] : raw[-1]].view(np.uint32)
    r, s, least = earliest(words_, (raw - raw[0]) // 4, where, passage)
    first = where.copy()
    np.minimum.at(first, r, least)
    late = where[r] + s > least
    r, s, least = r[late], s[late], least[late]
    edge = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1))) if len(r) else np.zeros(0, np.int64)
    last = np.append(edge[1:], len(r)) - 1 if len(r) else edge
    lead = lead[r[edge]]
    found = np.minimum.reduceat(least, edge) if len(edge) else least
    copy = ~head
    copy[np.flatnonzero(head) + 1] = False
    copy = np.flatnonzero(copy)
    out = (
        np.concatenate((doc[lead], doc[copy])),
        np.concatenate((node[lead], node[copy])),
        np.concatenate((start[lead] + s[edge], start[copy])).astype(np.int32),
        np.concatenate((start[lead] + s[last] + passage, start[copy] + size[copy])).astype(np.int32),
        ids[np.concatenate((found, first[read[copy]])) >> 32],
    )
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "node", "start", "stop", "first_doc_id"])


def _whole_anchors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows in order, in tables of about that many, cut between anchors only."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held)
        anchor = whole.column("anchor").to_numpy()
        end = int(np.searchsorted(anchor, anchor[-1]))
        if end:
            yield whole.slice(0, end)
        held, rows = whole.slice(end).to_batches(), len(anchor) - end
        most = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def spans(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """Stretches of words that repeat earlier passages.

    Returns (node, doc_id, start_word, end_word, first_doc_id): words start_word to end_word - 1 of
    the text, counted from 0, are covered by passages that stand earlier; first_doc_id is the
    earliest document that holds one of them.  Rows with equal doc_id and text are one document.  A
    null doc_id comes after the others, in the order of the texts' keys, and is given as null.
    Null, empty and short texts hold no passage; a text may repeat itself; passages that overlap or
    touch are one stretch; an empty table gives no rows; further columns are left out.
    """
    texts = docs.where("text IS NOT NULL").select("doc_id", content().alias("node"), "text")
    reach = passage - anchor

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, hashes = words(part.column("text"))
            text, position, value = anchors(offsets, hashes, passage, anchor)
            lo = np.maximum(position - reach, 0)
            hi = np.minimum(position + passage, np.diff(offsets)[text])
            key = mix(stretch_keys(hashes, offsets[text] + lo, offsets[text] + hi) + (position - lo).astype(U64)) if len(text) else value
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(key.view(np.int64)), part.column("doc_id").take(rows), part.column("node").take(rows), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                names=["anchor", "key", "doc_id", "node", "start", "size"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, hashes = words(part.column("text"))
            raw = (hashes >> U64(32)).astype(np.uint32).tobytes()
            marks = part.column("marks")
            begin = marks.offsets.to_numpy().astype(np.int64)
            flat = marks.values.slice(begin[0], begin[-1] - begin[0])
            lo = np.repeat(offsets[:-1], np.diff(begin)) + flat.field("start").to_numpy(zero_copy_only=False)
            hi = lo + flat.field("size").to_numpy(zero_copy_only=False)
            for at in range(0, len(lo), 8192):
                held = [raw[4 * a : 4 * b] for a, b in zip(lo[at : at + 8192].tolist(), hi[at : at + 8192].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field("anchor").slice(at, 8192), flat.field("key").slice(at, 8192), pa.array(held, pa.binary())], names=["anchor", "key", "words"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_anchors(batches, 4 * READS):
            yield match(rows, passage)

    named = texts.mapInArrow(name, "anchor long, key long, doc_id long, node long, start int, size int").repartition("anchor").distinct()
    in_order = [F.col("doc_id").asc_nulls_last(), "node", "start"]
    equal = Window.partitionBy("anchor", "key").orderBy(*in_order)
    every = Window.partitionBy("anchor")
    often = named.withColumn("n", F.count("*").over(every)).where("n > 1")
    often = often.withColumn("i", F.row_number().over(equal)).withColumn("first_doc_id", F.first("doc_id").over(equal)).withColumn("reads", F.count_if(F.col("i") == 1).over(every))
    often = cut(often.drop("n"))
    # An anchor with one read: all but the first are copies of it.
    copies = often.where("reads = 1 AND i > 1").select("doc_id", "node", "start", (F.col("start") + F.col("size")).alias("stop"), "first_doc_id")
    several = often.where("reads > 1")
    marks = several.where("i = 1").groupBy(F.col("node").alias("_node"), F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("anchor", "key", "start", "size")).alias("marks"))
    held = texts.join(marks, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).dropDuplicates(["node", "doc_id"])
    reads = held.select("text", "marks").mapInArrow(read, "anchor long, key long, words binary")
    rows = reads.select("anchor", "key", F.lit(None).cast("long").alias("doc_id"), *(F.lit(0).cast(k).alias(c) for c, k in (("node", "long"), ("start", "int"), ("size", "int"))), "words")
    rows = rows.unionByName(several.select("anchor", "key", "doc_id", "node", "start", "size", F.lit(None).cast("binary").alias("words")))
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "key", F.col("words").isNull(), *in_order)
    found = rows.mapInArrow(matched, "doc_id long, node long, start int, stop int, first_doc_id long")
    found = found.unionByName(copies.withColumn("first_doc_id", F.coalesce("first_doc_id", F.lit(int(_NO_ID)))).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(_NO_ID)))))
    # Stretches that overlap or touch are one.
    own = Window.partitionBy("node", "doc_id").orderBy("start", "stop")
    far = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.coalesce((F.col("start") > far).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy("node", "doc_id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
    real = lambda c: F.nullif(F.col(c), F.lit(int(_NO_ID))).alias(c)
    return joined.select("node", real("doc_id"), "start_word", "end_word", real("first_doc_id"))


def without(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without those stretches of words and the white space after them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        out.append(text[last : at[a]])
        last = at[b]
    out.append(text[last:])
    return "".join(out).rstrip() if last == len(text) else "".join(out)


def keep(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """docs with repeated passages cut out of text, n_chars (where there is one) counted anew.

    Rows of which nothing is left go; others stay as they are, as do all columns.
    """
    found = spans(docs.select("doc_id", "text"), passage)
    node, doc, starts, ends = unused(docs, "_node", "_doc", "_starts", "_ends")
    cuts = cut(found.groupBy(F.col("node").alias(node), F.col("doc_id").alias(doc)).agg(F.collect_list("start_word").alias(starts), F.collect_list("end_word").alias(ends)))
    here = (content(docs["text"]) == F.col(node)) & docs["doc_id"].eqNullSafe(F.col(doc)) & docs["text"].isNotNull()
    names = docs.columns
    i, n_chars, at = names.index("text"), names.index("n_chars") if "n_chars" in names else None, len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns = list(part.columns[:at])
            hit = part.column(at).is_valid()
            if hit.true_count:
                text = [without(*r) for r in zip(*(part.column(k).filter(hit).to_pylist() for k in (i, at, at + 1)), strict=True)]
                left = np.ones(part.num_rows, bool)
                left[hit.to_numpy(zero_copy_only=False)] = [_WORD.search(t) is not None for t in text]
                columns[i] = pc.replace_with_mask(columns[i], hit, pa.array(text, columns[i].type))
                if n_chars is not None:
                    columns[n_chars] = pc.replace_with_mask(columns[n_chars], hit, pa.array([len(t) for t in text], pa.int64()).cast(columns[n_chars].type))
                columns = [c.filter(pa.array(left)) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # All documents take this way: telling those without repeats apart would move them twice.
    return docs.join(cuts, here, "left").select(*map(column, names), starts, ends).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word", "first_doc_id")


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT doc_id, s, array_to_string(list_slice(t, s + 1, s + {PASSAGE}), ' ') AS run
      FROM (SELECT doc_id, t, unnest(range(len(t) - {PASSAGE} + 1)) AS s FROM w WHERE len(t) >= {PASSAGE})),
f AS (SELECT doc_id, s, first(doc_id) OVER o AS first_doc, row_number() OVER o AS r
      FROM p WINDOW o AS (PARTITION BY run ORDER BY doc_id, s)),
l AS (SELECT doc_id, s, first_doc, coalesce(s > max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {PASSAGE}, true) AS new
      FROM f WHERE r > 1),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM l)
SELECT doc_id, min(s)::INT AS start_word, (max(s) + {PASSAGE})::INT AS end_word, min(first_doc) AS first_doc_id
FROM i GROUP BY doc_id, island
"""
