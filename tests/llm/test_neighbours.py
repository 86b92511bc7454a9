import numpy as np
import pytest

from ngramforge.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: {ids[j] for j in np.argsort(-s[n], kind="stable")[:k]} for n, i in enumerate(ids)}, s


def recall(got, want):
    return sum(len(want[i] & set(got[i])) for i in want) / sum(map(len, want.values()))


def test_all_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want, s = brute(ids, x, neighbours.NEIGHBOURS)
    got = neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    assert len(got) == len(set(ids)) and recall({r.vec_id: r.neighbour_ids for r in got}, want) >= 0.95
    at = {i: n for n, i in enumerate(ids)}
    for r in got[:100]:
        assert r.similarities == sorted(r.similarities, reverse=True) and len(set(r.neighbour_ids)) == neighbours.NEIGHBOURS and r.vec_id not in r.neighbour_ids
        assert np.allclose(r.similarities, [s[at[r.vec_id], at[j]] for j in r.neighbour_ids], atol=1e-5)


def test_the_query_asks_for_a_part_against_all(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want, _ = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64), neighbours.NEIGHBOURS)
    got = {r.vec_id: r.neighbour_ids for r in neighbours.query(spark, sf_dir).collect()}
    assert set(got) == {i for i in want if i % 20 == 0} and recall(got, {i: want[i] for i in got}) >= 0.95
    assert any(j % 20 for near in got.values() for j in near)


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    rows = [(i, x[i].tolist() if i < 300 else x[0].tolist()) for i in range(700)]
    got = {r.vec_id: r for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()}
    assert len(got) == 700
    assert got[0].neighbour_ids == list(range(300, 310)) and got[650].neighbour_ids == [0, *range(300, 309)] and got[305].neighbour_ids == [0, *range(300, 305), *range(306, 310)]
    assert all(abs(s - 1) < 1e-9 for s in got[650].similarities) and len(set(got[7].neighbour_ids)) == 10


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall_beyond_the_leaves(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 24))
    if kind == "clusters":
        x = 3 * rng.normal(size=(60, 24))[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, _ = brute(list(range(4000)), x, 10)
    got = {r.vec_id: r.neighbour_ids for r in neighbours.nearest(frame).collect()}
    assert recall(got, want) >= 0.9


def test_queries_walk_the_graph(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact, dim = neighbours.valid(rows)
    vectors = neighbours.cut(neighbours.packed(exact, dim))
    graph = neighbours.descend(vectors, dim)
    asked = rng.normal(size=(50, 16))
    frame = spark.createDataFrame([(10_000 + i, v.tolist()) for i, v in enumerate(asked)], "id long, x array<double>")
    from pyspark.sql import functions as F

    queries = neighbours.packed(frame, 16).withColumn("start", F.array(*(F.lit(int(i)) for i in rng.integers(0, 1500, 8))))
    found = {r.id: r.ids[:10] for r in neighbours.search(queries, graph, vectors, dim, 40).collect()}
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit(asked) @ unit(x).T
    want = {10_000 + i: set(np.argsort(-s[i])[:10].tolist()) for i in range(50)}
    assert recall(found, want) >= 0.9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0]), (2, [0.9, 0.1]), (10, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "s", "t") for r in rows], SCHEMA + ", id int, x string, node string")
    got = {r.vec_id: r for r in neighbours.nearest(frame, k=3).collect()}
    assert set(got) == set(range(1, 11))
    assert all(got[i].neighbour_ids is None and got[i].similarities is None for i in (4, 5, 6, 7, 8))
    assert got[1].neighbour_ids == [10, 2, 3] and np.allclose(got[1].similarities, [1, 0.9939, 0], atol=1e-3)
    assert got[10].neighbour_ids == [1, 2, 3] and got[9].similarities == [0, 0, 0]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = neighbours.nearest(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.vec_id, r.neighbour_ids) for r in alone] == [(1, [])]
    nothing = neighbours.nearest(spark.createDataFrame([(1, None)], SCHEMA)).collect()
    assert [(r.vec_id, r.neighbour_ids) for r in nothing] == [(1, None)]
