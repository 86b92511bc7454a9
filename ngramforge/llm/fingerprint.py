"""Document fingerprints by consistent weighted sampling.

Each of the samples draws, for every term, r and c from Gamma(2, 1) and b from U(0, 1), all fixed
by the term and the sample.  With weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b) - r.
The term of least a and its t are the sample.  Two documents agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of minimum weights over sum of maximum ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ngramforge.llm.common import U64, list_array, mix, segment_ids, slices, table, words

SAMPLES = 64
#: Weighted terms worked on at a time.
CHUNK_TERMS = 4096


def normal(word: str) -> str:
    """Lower case, without characters around the word that are neither letters nor digits."""
    word = word.lower()
    if word.isalnum():
        return word
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    return word[lo:hi]


def draws(terms: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each term and sample, from counters: nothing is kept between workers."""
    lane = mix(np.arange(1, 5 * samples + 1, dtype=U64).reshape(5, samples) + U64(seed) * U64(0x9E3779B97F4A7C15))

    def uniform(i: int) -> np.ndarray:
        return ((mix(terms[:, None] ^ lane[i][None, :]) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53

    r = -np.log(uniform(0) * uniform(1))
    return r, np.log(-np.log(uniform(2) * uniform(3))), uniform(4)


def table_of(terms: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """draws() in single precision, a chunk at a time."""
    out = tuple(np.empty((len(terms), samples), np.float32) for _ in range(3))
    for i in range(0, len(terms), CHUNK_TERMS):
        for x, part in zip(out, draws(terms[i : i + CHUNK_TERMS], samples, seed), strict=True):
            x[i : i + CHUNK_TERMS] = part
    return out


def signatures(offsets: np.ndarray, hashes: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct terms of each document, and its samples as 64-bit values (0 where it has no term).

    Equal values of ln a go to the term of least hash.
    """
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, samples), U64)
    terms, codes = np.unique(hashes, return_inverse=True)
    pairs, weight = np.unique(segment_ids(offsets) * max(1, len(terms)) + codes, return_counts=True)
    doc, code = np.divmod(pairs, max(1, len(terms)))
    sizes = np.bincount(doc, minlength=n_docs)
    if not len(terms):
        return sizes, out
    r, log_c, b = table_of(terms, samples, seed)
    log_s = np.log(weight).astype(np.float32)
    ends = np.cumsum(sizes)
    at = 0
    while at < n_docs:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK_TERMS, side="right")))
        top = int(ends[stop - 1])
        if top > base:
            g = code[base:top]
            own_r, own_b = r[g], b[g]
            t = np.floor(log_s[base:top, None] / own_r + own_b)
            log_a = log_c[g] - own_r * (t - own_b + 1)
            some = np.arange(at, stop)[sizes[at:stop] > 0]
            least = np.minimum.reduceat(log_a, ends[some] - sizes[some] - base, axis=0)
            row, column = np.nonzero(log_a == np.repeat(least, sizes[some], axis=0))
            row, column = row[::-1], column[::-1]
            value = mix(terms[g[row]] ^ mix(t[row, column].astype(np.int64).view(U64)))
            out[doc[base:top][row], column] = value
        at = stop
    return sizes, out


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """Signature of each document; a term's weight is how often it stands in the text.

    The draws are rounded to single precision, which may decide between terms whose values differ
    by less: a sample in a thousand at most.

    Returns (doc_id, n_terms, signature array<long>), a row for each row of docs; nothing is
    shuffled.  A null text gives nulls; a text without words has an empty signature; a null doc_id
    stays; repeated rows have equal signatures; an empty table gives no rows; further columns are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = part.column("text")
            sizes, out = signatures(*words(text, normal), samples, seed)
            full = np.where(sizes > 0, samples, 0)
            lists = list_array(np.concatenate(([0], np.cumsum(full))), out[sizes > 0].reshape(-1).view(np.int64), pa.int64())
            valid = text.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes.astype(np.int32), mask=~valid), pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~valid))],
                names=["doc_id", "n_terms", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_terms int, signature array<long>")


def agreement(a: Column | str, b: Column | str) -> Column:
    """Share of equal samples: the estimated similarity; null where either has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.try_divide(same, F.size(a))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
