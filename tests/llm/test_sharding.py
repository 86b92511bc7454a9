import random

import pytest

from ngramforge.llm import sharding


def plain(sizes, capacity):
    """Best fit decreasing, one group at a time: the sorted loads of the shards."""
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= s]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= s
        else:
            room.append(max(capacity, s) - s if s <= capacity else -1)
            if s > capacity:
                room[-1] = -s
    return sorted(capacity - r if r >= 0 else -r for r in room)


def loads(histogram, capacity):
    ranges, shards = sharding.assign(histogram, capacity)
    out = {}
    for size, lo, hi, first, each in ranges:
        for rank in range(lo, hi):
            shard = first + (rank - lo) // each
            out[shard] = out.get(shard, 0) + size
    assert set(out) == set(range(shards))
    return sorted(out.values()), ranges


@pytest.mark.parametrize("seed", range(30))
def test_as_one_group_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.randint(5, 60)
    sizes = [rng.randint(1, capacity + 5) for _ in range(rng.randint(1, 200))]
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    got, ranges = loads(histogram, capacity)
    assert got == plain(sizes, capacity)
    for s, n in histogram:
        assert sorted(r for size, lo, hi, *_ in ranges if size == s for r in range(lo, hi)) == list(range(n))


def test_tree():
    rng = random.Random(2)
    tree, held = sharding.Tree(), {}
    for _ in range(2000):
        if held and rng.random() < 0.4:
            key = rng.choice(list(held))
            tree.remove(key)
            del held[key]
        else:
            key = rng.randrange(500)
            tree.add(key, (1, 1))
            held[key] = held.get(key, 0) + 1
        asked = rng.randrange(520)
        found = tree.tightest(asked)
        assert (found[0] if found else None) == min((k for k in held if k >= asked), default=None)


def test_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for capacity in (50_000, sharding.CAPACITY):
        got = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity).collect()
        assert {r.doc_id for r in got} == texts.keys()
        where, load = {}, {}
        for r in got:
            assert r.n_bytes == len((texts[r.doc_id] or "").encode())
            where.setdefault(texts[r.doc_id], set()).add(r.shard)
            load[r.shard] = load.get(r.shard, 0) + r.n_bytes
        assert all(len(s) == 1 for s in where.values()) and set(load) == set(range(len(load)))
        groups = {}
        for r in got:
            groups[texts[r.doc_id]] = r.group_bytes
        assert all(n <= capacity or sum(g for t, g in groups.items() if s in where[t]) == n for s, n in load.items())
        # Loads are those of best fit decreasing of the real sizes, byte by byte.
        assert sorted(n for n in load.values() if n) == [n for n in plain([n for n in groups.values() if n], capacity) if n]


def test_odd_documents(spark, clashing, odd_rows, none):
    got = sharding.shard(clashing, 2000).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].shard == by[5][0].shard == by[5][1].shard and by[5][0].group_bytes == 3 * by[5][0].n_bytes
    assert by[2][0].n_bytes == 0 and by[2][0].shard == by[3][0].shard == 0
    alone = by[6][0]
    assert alone.n_bytes > 2000 and sum(r.shard == alone.shard and r.n_bytes > 0 for r in got) == 1
    assert sharding.shard(none).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.shard for r in sharding.shard(empty).collect()} == {0}


def test_ranks_go_on_over_parts_and_spans(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPAN", 4)
    rng = random.Random(4)
    texts = [f"{i:05d}" + "x" * rng.choice([0, 0, 0, 3, 9]) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sharding.shard(docs, 37).collect()
    load = {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.n_bytes
    assert len(got) == 600 and sorted(load.values()) == plain([len(t) for t in texts], 37)
