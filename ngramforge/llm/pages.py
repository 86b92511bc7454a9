"""HTML extraction by differencing each page with the page of the nearest URL.

Pages of a host stand in the order of their paths; of the two neighbours the one that shares more
leading path segments is the partner.  Lines that the longest common subsequence of both pages'
text lines holds are the template and are deleted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.llm.common import cut, slices, table

_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|button|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>|\n", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")


def lines(page: str) -> list[str]:
    """Text lines of a page: a block element or line break starts a new one; blanks are joined and empty lines left out."""
    text = _TAG.sub("", _BREAK.sub("\x00", _UNSEEN.sub("", page)))
    if "&" in text:
        text = html.unescape(text)
    return [line for line in (" ".join(x.split()) for x in text.split("\x00")) if line]


#: Bits of a table of subsequence lengths that are held at once; a larger table is halved.
TABLE_BITS = 1 << 26


def _row(own: list[int], other: list[int]) -> int:
    """The last row of the table of subsequence lengths: a zero bit for each place of own where the length grows."""
    where: dict[int, int] = {}
    for k, x in enumerate(own):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(own)) - 1
    for x in other:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return row


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of other with each prefix of own."""
    size = len(own)
    bits = np.unpackbits(np.frombuffer(_row(own, other).to_bytes(-(-size // 8) or 1, "little"), np.uint8), bitorder="little", count=size)
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _common(own: list[int], other: list[int]) -> list[int]:
    """Positions of own that a longest common subsequence takes, in memory proportional to the lines.

    A small table is kept whole, as a row of bits for each element of other, and walked back.  Of a
    larger one only the last rows of both halves of other are computed, which tell where own is to
    be cut.
    """
    if not own or not other:
        return []
    if len(own) * len(other) > TABLE_BITS and len(other) > 1:
        mid = len(other) // 2
        ahead, back = _lengths(own, other[:mid]), _lengths(own[::-1], other[mid:][::-1])
        at = int((ahead + back[::-1]).argmax())
        return _common(own[:at], other[:mid]) + [at + k for k in _common(own[at:], other[mid:])]
    where: dict[int, int] = {}
    for k, x in enumerate(own):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(own)) - 1
    rows = []
    for x in other:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j, out = len(own), len(other), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared(own: list[int], other: list[int]) -> list[int]:
    """Positions of own that a longest common subsequence with other takes.

    Equal ends are taken first; elements that the other side lacks cannot be taken.
    """
    lo, hi = 0, 0
    most = min(len(own), len(other))
    while lo < most and own[lo] == other[lo]:
        lo += 1
    while hi < most - lo and own[-1 - hi] == other[-1 - hi]:
        hi += 1
    mine, theirs = set(own[lo : len(own) - hi]), set(other[lo : len(other) - hi])
    at = [i for i in range(lo, len(own) - hi) if own[i] in theirs]
    middle = [at[k] for k in _common([own[i] for i in at], [x for x in other[lo : len(other) - hi] if x in mine])]
    return [*range(lo), *middle, *range(len(own) - hi, len(own))]


def _same_segments(a: Column, b: Column) -> Column:
    equal = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x.eqNullSafe(y), F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(F.size(equal))


PAGE = "host string, dir string, path string, page_id long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page of a task's range with the ones before and after it; edge: the first and the last page, which lack one."""
    names = ["host", "dir", "path", "page_id"]
    held: pa.Table | None = None  # the last two pages, of which the first is done
    for batch in _ended(batches):
        if batch is not None:
            rows = pa.Table.from_batches([batch]).select(names)
            rows = rows if held is None else pa.concat_tables([held, rows])
        elif held is None:
            return
        else:
            rows = held
        n, first, last = rows.num_rows, held is None or held.num_rows == 1, batch is None
        begin, end = (0 if first else 1), (n if last else n - 1)
        if end > begin:
            index = np.arange(begin, end)
            before, after = pa.array(index - 1, mask=index == 0), pa.array(index + 1, mask=index == n - 1)
            own = rows.slice(begin, end - begin)
            out = {c: own.column(c) for c in names}
            out |= {f"prev_{c}": rows.column(c).take(before) for c in names} | {f"next_{c}": rows.column(c).take(after) for c in names}
            out["edge"] = pa.array((index == 0) | (index == n - 1))
            yield from pa.table(out).to_batches()
        held = rows.slice(max(0, n - 2))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that hold rows, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def partners(pages: DataFrame) -> DataFrame:
    """(page_id, partner_id): the page next to each in its host.

    Only ids and URLs are moved, to ranges of the order of host, directory, path and id, whatever a
    host or directory holds; a task finds neighbours within its range, and its first and last page
    meet those of the ranges next to it: two rows a task.
    """
    url = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"
    nav = pages.where(F.col("page_id").isNotNull() & F.col("url").isNotNull()).groupBy("page_id").agg(F.min("url").alias("url"))
    nav = nav.select("page_id", F.lower(F.regexp_extract("url", url, 1)).alias("host"), F.regexp_extract("url", url, 2).alias("path")).where("host <> ''")
    nav = nav.withColumn("dir", F.regexp_replace("path", "[^/]*$", "")).select("host", "dir", "path", F.col("page_id").cast("long").alias("page_id"))
    order = ["host", "dir", "path", "page_id"]
    kind = PAGE + "".join(f", {side}_{c}" for side in ("prev", "next") for c in PAGE.split(", ")) + ", edge boolean"
    placed = cut(nav.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, kind))
    far = Window.orderBy(*order)
    ends = placed.where("edge")
    for c in order:
        ends = ends.withColumn(f"prev_{c}", F.coalesce(f"prev_{c}", F.lag(c).over(far))).withColumn(f"next_{c}", F.coalesce(f"next_{c}", F.lead(c).over(far)))
    both = placed.where("NOT edge").unionByName(ends)
    near = {side: F.when(F.col(f"{side}_host") == F.col("host"), _same_segments(F.col(f"{side}_path"), F.col("path"))) for side in ("prev", "next")}
    partner = F.when(near["prev"].isNull() | (near["next"] > near["prev"]), F.when(near["next"].isNotNull(), F.col("next_page_id"))).otherwise(F.col("prev_page_id"))
    return both.select("page_id", partner.alias("partner_id")).where("partner_id IS NOT NULL")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        keys = [[xxhash.xxh64_intdigest(x) - 2**63 for x in lines(p)] if p else [] for p in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(keys, pa.list_(pa.int64()))], names=["page_id", "keys"])


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        found = [lines(p) if p is not None else None for p in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(found, pa.list_(pa.string()))], names=["page_id", "own"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"page_id": batch.column("page_id").to_pylist(), "partner_id": batch.column("partner_id").to_pylist(), "n_lines": [], "n_deleted": [], "text": []}
        for own, keys in zip(batch.column("own").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            if own is None:
                out["n_lines"].append(None), out["n_deleted"].append(None), out["text"].append(None)
                continue
            gone = set(shared([xxhash.xxh64_intdigest(x) - 2**63 for x in own], keys)) if keys else set()
            if len(gone) == len(own):
                gone = set()
            out["n_lines"].append(len(own)), out["n_deleted"].append(len(gone))
            out["text"].append("\n".join(x for i, x in enumerate(own) if i not in gone))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("partner_id", pa.int64()), ("n_lines", pa.int32()), ("n_deleted", pa.int32()), ("text", pa.string())]))


def extract(pages: DataFrame) -> DataFrame:
    """Text of each page without the lines that it shares with its partner.

    Returns (page_id, partner_id, n_lines, n_deleted, text), a row for each row of pages.  The
    partner's lines travel as 64-bit keys only; the page's own text is shuffled once.  A null html
    gives null counts and text, an empty one an empty text.  A page with a null page_id, a URL
    without host, or no other page in its host has no partner and keeps all lines; so does one
    whose every line is shared, as a copy tells nothing about the template.  Rows that repeat a
    page_id are one page for the choice of partners (least URL, least keys) and are differenced
    each; equal paths stand in the order of page_id; an empty table gives no rows; further
    columns are left out.
    """
    pair = partners(pages.select("page_id", "url"))
    keys = pages.select("page_id", "html").where("page_id IS NOT NULL").mapInArrow(_hashes, "page_id long, keys array<long>")
    keys = keys.groupBy(F.col("page_id").alias("partner_id")).agg(F.min("keys").alias("keys"))
    own = pages.select("page_id", "html").mapInArrow(_text, "page_id long, own array<string>")
    joined = own.join(pair.join(keys, "partner_id"), "page_id", "left").select("page_id", "partner_id", "own", "keys")
    return joined.mapInArrow(_difference, "page_id long, partner_id long, n_lines int, n_deleted int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
