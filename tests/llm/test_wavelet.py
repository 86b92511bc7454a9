import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ngramforge.llm import bpe, wavelet


@pytest.mark.parametrize("n, top", [(0, 9), (1, 1), (5, 2), (513, 50_000), (5000, 7)])
def test_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    m = wavelet.WaveletMatrix(wavelet.pack(ids, [3, None], np.array([0, n // 2, n]), 16))
    assert m.doc_ids == [3, None] and m.n == n and np.array_equal(m.tokens(), ids)
    assert m.document(0) == ids[: n // 2].tolist()
    for i in range(0, n, max(1, n // 60)):
        assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for token in {*ids[:20].tolist(), 0, 65_535}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where)
        assert [m.select(token, k) for k in range(min(5, len(where)))] == where[:5].tolist()
    if n:
        assert m.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()
    for bad in (lambda: m.access(n), lambda: m.select(0, m.count(0)), lambda: wavelet.WaveletMatrix(b"nothing like it")):
        with pytest.raises((IndexError, ValueError)):
            bad()
    assert m.count(1 << 20) == 0 == m.count(-1)


def read_back(shards):
    out = []
    for r in shards:
        m = wavelet.WaveletMatrix(r.file)
        ids = m.tokens()
        assert r.n_tokens == m.n == len(ids) and r.n_docs == len(m.doc_ids) and r.doc_ids == m.doc_ids
        out += [(d, ids[a:b].tolist()) for d, a, b in zip(m.doc_ids, m.offsets[:-1], m.offsets[1:], strict=True)]
    return out


def test_all_documents(spark, sf_dir):
    want = {r.doc_id: r.ids for r in bpe.query(spark, sf_dir).collect()}
    assert dict(read_back(wavelet.query(spark, sf_dir).collect())) == want
    small = wavelet.token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shard_tokens=5000).collect()
    assert len(small) > 5 and len({r.shard_id for r in small}) == len(small) and dict(read_back(small)) == want
    first = small[0]
    token = want[first.doc_ids[0]][0]
    counted = wavelet.count_tokens(spark.createDataFrame(small), [token, 0])
    assert {(r.shard_id, r.n) for r in counted.where(f"token = {token}").collect()} == {(r.shard_id, sum(want[d].count(token) for d in r.doc_ids)) for r in small}


def test_saved(spark, odd, tmp_path):
    shards = wavelet.token_shards(odd, shard_tokens=1000)
    wavelet.save(shards, str(tmp_path / "shards"))
    want = shards.orderBy("shard_id").collect()
    assert wavelet.load(spark, str(tmp_path / "shards")).orderBy("shard_id").collect() == want
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == len(want)


def test_shards_follow_the_documents_not_the_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = wavelet.token_shards(docs, shard_tokens=5000, shard_docs=32).orderBy("shard_id").collect()
    assert a == wavelet.token_shards(docs.repartition(9, "source"), shard_tokens=5000, shard_docs=32).orderBy("shard_id").collect()
    ids = [d for r in a for d in r.doc_ids]
    assert ids == sorted(ids) and len(a) > 20
    nobody = wavelet.token_shards(docs.withColumn("doc_id", F.lit(None).cast("long")), shard_tokens=5000, shard_docs=32).collect()
    assert sum(r.n_docs for r in nobody) == len(ids) and len({r.shard_id >> 32 for r in nobody}) > 3


def test_the_commonest_token_of_a_large_shard():
    rng = np.random.default_rng(3)
    n = 1 << 21
    ids = np.where(rng.random(n) < 0.17, 11, rng.integers(0, 50_000, n))
    m = wavelet.WaveletMatrix(wavelet.pack(ids, [1], np.array([0, n]), 16))
    where = np.flatnonzero(ids == 11)
    began = time.perf_counter()
    assert m.occurrences(11) == where.tolist()
    assert time.perf_counter() - began < 3
    some = rng.integers(0, len(where), 2000)
    assert np.array_equal(m.selects(11, some), where[some]) and [m.select(11, int(k)) for k in some[:20]] == where[some[:20]].tolist()
    at = rng.integers(0, n, 3000)
    assert np.array_equal(m.accesses(at), ids[at])
    assert [m.rank(11, int(i)) for i in at[:50]] == [int((ids[:i] == 11).sum()) for i in at[:50]]


def test_odd_documents(clashing, odd_rows, none):
    got = read_back(wavelet.token_shards(clashing, shard_tokens=1000).collect())
    assert sorted((str(d), bool(t)) for d, t in got) == sorted((str(d), bool(t)) for d, t, *_ in odd_rows)
    assert wavelet.token_shards(none).count() == 0
