import random

import numpy as np
import pyarrow as pa
import pytest

from ngramforge.llm import minhash
from ngramforge.llm.common import words
from ngramforge.llm.components import components
from ngramforge.llm.fingerprint import normal
from tests.llm.conftest import sentence


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def tokens(text):
    return [w for w in map(normal, text.split()) if w]


def brute(rows, similarity=minhash.SIMILARITY):
    """Groups of rows (doc_id, text) by comparing all pairs: representative row of each, by union."""
    own = [tokens(t) if t is not None else None for _, t in rows]
    code = {}
    arrays = [np.array([code.setdefault(w, len(code)) for w in t], np.int64) if t else None for t in own]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            if rows[i][1] == rows[j][1]:
                parent[find(i)] = find(j)
                continue
            if not own[i] or not own[j]:
                continue
            longest = max(len(own[i]), len(own[j]))
            limit = int((1 - similarity) * longest + 1e-9)
            if abs(len(own[i]) - len(own[j])) <= limit and minhash.distances([(arrays[i], arrays[j])], np.array([limit]))[0] <= limit:
                pairs.append((i, j))
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], pairs


def test_distances():
    rng = random.Random(4)
    pairs, want = [], []
    for _ in range(300):
        a = [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(8) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(8)] * rng.randint(0, 1)
        pairs.append((np.array(a, np.int64), np.array(b, np.int64)))
        want.append(edit(a, b))
    limits = np.array([rng.randint(0, 45) for _ in pairs])
    assert minhash.distances(pairs, limits).tolist() == [min(d, m + 1) for d, m in zip(want, limits)]
    a = [rng.randrange(50) for _ in range(900)]
    b = a[100:] + a[:100]
    assert minhash.distances([(np.array(a), np.array(b))], np.array([900])).tolist() == [edit(a, b)]


def sketch(*texts, samples=600):
    return minhash.sketches(*words(pa.array(texts), normal), samples=samples)


def test_sketches():
    rng = random.Random(6)
    a = [f"w{rng.randrange(1000)}" for _ in range(200)]
    moved = a[100:] + a[:100]
    changed = list(a)
    changed[50] = "other"
    s = sketch(" ".join(a), " ".join(a).upper() + "!", " ".join(changed), " ".join(moved), "two words", "", "...")
    rate = lambda i, j: float((s[i] == s[j]).mean())
    assert rate(0, 1) == 1 and 0.85 < rate(0, 2) < 1
    assert rate(0, 3) < 0.5, "the order of the text counts, not only its content"
    assert (s[4] != 0).all() and (s[5:] == 0).all()
    twice = sketch("a b c d", "a b c d a b c d")
    assert (twice[0] != twice[1]).any(), "repeats are labelled"


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 100), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and {got.get(i, 100) for i in (100, 101, 102, 200)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_all_documents_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    group, pairs = brute(rows)
    removed = {r.doc_id: r for r in minhash.query(spark, sf_dir).collect()}
    first = {}
    for (doc_id, _), g in zip(rows, group):
        first[g] = min(first.get(g, doc_id), doc_id)
    want = {d for (d, _), g in zip(rows, group) if d != first[g]}
    assert removed.keys() <= want and len(removed) >= 0.97 * len(want)
    at = {d: i for i, (d, _) in enumerate(rows)}
    assert all(group[at[r.doc_id]] == group[at[r.kept_doc_id]] and r.kept_doc_id < d for d, r in removed.items())
    stays = {d: removed[d].kept_doc_id if d in removed else d for d, _ in rows}
    together = sum(stays[rows[i][0]] == stays[rows[j][0]] for i, j in pairs)
    assert together >= 0.95 * len(pairs)


@pytest.mark.parametrize("changes, found", [(2, True), (12, True), (70, False)])
def test_planted_copies(spark, changes, found):
    rng = random.Random(changes)
    body = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        copy = list(body)
        for at in rng.sample(range(150), changes) if i else ():
            copy[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(150))) for i in range(20)]
    got = minhash.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == (59 if found else 0) and all(r.kept_doc_id == 0 and r.group_size == 60 for r in got)


def test_odd_documents(odd, clashing, odd_rows, none):
    gone = sorted((r.doc_id, r.kept_doc_id, r.group_size) for r in minhash.duplicates(clashing).collect())
    assert gone == [(5, 1, 3), (5, 1, 3)]
    kept = minhash.keep(clashing)
    assert kept.columns == clashing.columns and kept.schema == clashing.schema
    want = [r for r in odd_rows if r[0] != 5]
    assert sorted(map(str, (tuple(r)[:5] for r in kept.collect()))) == sorted(map(str, want))
    assert {tuple(r)[5:] for r in kept.collect()} == {tuple(f"x{i}" for i in range(len(kept.columns) - 5))}
    assert minhash.keep(none).count() == 0 == minhash.duplicates(none).count()


def test_repeated_rows_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, "b"), (None, text, "a"), (3, text + " end", "c"), (3, text + " end", "d"), (3, text, "e"), (4, "x", "f"), (4, "x", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(map(tuple, minhash.keep(docs).collect()))
    assert len(kept) == 2 and kept[0][0] == 3 and kept[1] == (4, "x", "f")
    assert kept == sorted(map(tuple, minhash.keep(docs.repartition(5, "source")).collect()))
    nobody = spark.createDataFrame([(None, "a b c d", "x"), (None, "a b c d", "y")], docs.schema)
    assert minhash.keep(nobody).count() == 1


def edited(rng, body, changes):
    copy = list(body)
    for at in rng.sample(range(len(body)), changes):
        copy[at] = f"z{rng.randrange(10**9)}"
    return copy


def test_copies_of_one_original_that_differ_from_each_other(spark):
    rng = random.Random(12)
    body = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, body, rng.randint(30, 40)) if i else body)) for i in range(1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = np.array([[hash(w) for w in t.split()] for _, t in rows])
    assert np.mean([(own[i] != own[j]).mean() > 0.25 for i in range(1, 40) for j in range(i)]) > 0.9
    # What no sample joins to the group can't be found; each two texts that share one are.
    s = minhash.sketches(*words(pa.array([t for _, t in rows]), normal))
    similar = {(i, j) for i in range(1001) for j in np.flatnonzero((own != own[i]).sum(axis=1) <= 50).tolist() if j > i and (s[i] == s[j]).any()}
    parent = list(range(1001))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in similar:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(1001) if find(i) != i}
    assert len(want) > 950
    assert {r.doc_id for r in minhash.duplicates(docs).collect()} == want


@pytest.mark.parametrize("length", [60, 200, 600])
def test_recall_at_the_threshold(length):
    rng = random.Random(length)
    texts = []
    for _ in range(300):
        body = [f"w{rng.randrange(3000)}" for _ in range(length)]
        texts += [" ".join(body), " ".join(edited(rng, body, length // 4))]
    s = minhash.sketches(*words(pa.array(texts), normal))
    assert (s[::2] == s[1::2]).any(axis=1).mean() >= 0.9


def test_pairs_that_are_ruled_out_are_far_apart():
    rng = random.Random(9)
    body = [f"w{rng.randrange(300)}" for _ in range(100)]
    texts = [" ".join(edited(rng, body, rng.randint(0, 60))[: rng.randint(60, 100)]) for _ in range(60)]
    offsets, hashes = words(pa.array(texts), normal)
    cells, n = minhash.histograms(offsets, (hashes >> np.uint64(32)).astype(np.uint32)), np.diff(offsets)
    own = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    i, j = np.triu_indices(len(texts), 1)
    limits = minhash.limit_of(n[i], n[j], minhash.SIMILARITY)
    near = minhash.distances([(own[a], own[b]) for a, b in zip(i, j)], limits) <= limits
    maybe = minhash.possible(cells[i], cells[j], n[i], n[j], minhash.SIMILARITY)
    assert near.any() and not near.all() and (maybe | ~near).all() and not maybe.all()


@pytest.mark.parametrize("low, high", [(1, 3), (3, None), (1, None)])
def test_blocks_cover_all_pairs(spark, monkeypatch, low, high):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(low)
    full = np.zeros(minhash.CELLS, np.uint8).tobytes()
    rows = [(s, 100 * s + at, rng.choice([10, 11, 12]) if at < 9 else 14, rng.randrange(4), full) for s in (1, 2) for at in range(15)]
    rows = [r for s in (1, 2) for r in sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1]))]
    placed = [(s, node, n, root, cells, k % 15, 15) for k, (s, node, n, root, cells) in enumerate(rows)]
    got = minhash.across(spark.createDataFrame(placed, "sample long, node long, n int, root long, cells binary, at int, rows long"), low, high).collect()
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in placed for b in placed if a[0] == b[0] and low <= b[5] - a[5] < (high or 99) and a[3] != b[3] and b[2] - a[2] <= int(0.25 * b[2] + 1e-9)}
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_more_positions_than_a_hash_gives_way_to(monkeypatch):
    rng = random.Random(2)
    texts = [sentence(rng, 3000, 200), "a b c", sentence(rng, 40)]
    before = sketch(*texts)
    monkeypatch.setattr(minhash, "POSITION_BITS", 3)
    assert (sketch(*texts) == before).all()


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash, "content", lambda text="text": minhash.F.length(minhash.F.col(text) if isinstance(text, str) else text).cast("long"))
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, b), (3, b), (4, a), (5, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept_doc_id) for r in minhash.duplicates(docs).collect()) == [(3, 2), (4, 1)]
    assert sorted(r.doc_id for r in minhash.keep(docs).collect()) == [1, 2, 5]
