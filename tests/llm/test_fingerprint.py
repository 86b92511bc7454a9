from collections import Counter

import pyarrow as pa
import pytest

from ngramforge.llm import fingerprint
from ngramforge.llm.common import words


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("a, b", [("a a a b c", "a b b c d"), ("a " * 9 + "b", "a b"), ("x y z", "x y z"), ("p q", "r s"), ("a b c d e f g h", "a b c d e f g i i i")])
def test_collision_rate_is_generalised_jaccard(a, b):
    n = 4000
    _, out = fingerprint.signatures(*words(pa.array([a, b]), fingerprint.normal), n, 1)
    assert abs(float((out[0] == out[1]).mean()) - jaccard(a, b)) < 0.035


def test_draws():
    import numpy as np

    from ngramforge.llm.common import mix

    r, c, b = fingerprint.draws(mix(np.arange(1, 2001, dtype=np.uint64)), 50, 1)
    for x in (r, np.exp(c)):  # gamma of shape 2: mean and variance 2
        assert abs(x.mean() - 2) < 0.05 and abs(x.var() - 2) < 0.1
    assert abs(b.mean() - 0.5) < 0.01 and b.min() > 0 and b.max() < 1


def brute(text, samples):
    """One document at a time, term by term in double precision."""
    import numpy as np
    import xxhash

    count = Counter(w for w in map(fingerprint.normal, text.split()) if w)
    terms = sorted(xxhash.xxh64_intdigest(w.encode()) for w in count)
    weight = {xxhash.xxh64_intdigest(w.encode()): n for w, n in count.items()}
    best = [None] * samples
    for term in terms:
        r, log_c, b = (x[0] for x in fingerprint.draws(np.array([term], np.uint64), samples, 1))
        t = np.floor(np.log(weight[term]) / r + b)
        log_a = log_c - r * (t - b + 1)
        for s in range(samples):
            if best[s] is None or log_a[s] < best[s][0]:
                best[s] = (log_a[s], term, int(t[s]))
    return [(x[1], x[2]) for x in best]


def test_all_documents_as_brute_force(spark, sf_dir):
    import numpy as np

    from ngramforge.llm.common import U64, mix

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in fingerprint.query(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    same = total = 0
    for doc_id in texts:
        pairs = brute(texts[doc_id], fingerprint.SAMPLES)
        want = [int((mix(np.array([k], U64) ^ mix(np.array([t], np.int64).view(U64))))[0].view(np.int64)) for k, t in pairs]
        same += sum(a == b for a, b in zip(want, got[doc_id].signature, strict=True))
        total += len(want)
    assert same >= 0.999 * total  # single precision decides near ties


def test_odd_documents(spark, clashing, odd_rows, none):
    got = fingerprint.fingerprints(clashing).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].signature is None and by[2][0].n_terms is None
    assert by[3][0].signature == [] and by[4][0].n_terms == 0 and by[7][0].signature == []
    assert by[5][0] == by[5][1] and by[1][0].signature == by[5][0].signature and len(by[6][0].signature) == fingerprint.SAMPLES
    assert fingerprint.fingerprints(none).count() == 0
    pair = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 5, 6]), ([], [])], "a array<long>, b array<long>").select(fingerprint.agreement("a", "b").alias("s"))
    assert [r.s for r in pair.collect()] == [0.5, None]
