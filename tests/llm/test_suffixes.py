import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ngramforge.llm import suffixes
from ngramforge.llm.common import words
from tests.llm.conftest import sentence


def brute(rows, passage):
    """{(doc_id, text): set of positions of words covered by passages that stand earlier}, rows distinct and in order."""
    seen, out = {}, {}
    for doc_id, text in rows:
        w = (text or "").split()
        covered = out.setdefault((doc_id, text), set())
        for i in range(len(w) - passage + 1):
            if tuple(w[i : i + passage]) in seen:
                covered.update(range(i, i + passage))
            seen.setdefault(tuple(w[i : i + passage]), (doc_id, i))
    return out


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(100):
        reads = [[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 8))]
        size = np.array([len(r) for r in reads])
        symbols = np.zeros((len(reads), size.max()), np.uint16)
        for i, r in enumerate(reads):
            symbols[i, : len(r)] = r
        read, start, common = suffixes.suffix_order(symbols, size)
        got = [tuple(reads[r][s:]) for r, s in zip(read, start)]
        assert got == sorted(tuple(r[s:]) for r in reads for s in range(len(r)))
        for a, b, n in zip(got, got[1:], common.tolist()):
            same = 0
            while same < min(len(a), len(b)) and a[same] == b[same]:
                same += 1
            assert same == n


def test_every_passage_names_an_anchor():
    rng = random.Random(2)
    texts = [sentence(rng, n, 30) for n in (0, 5, 12, 60)]
    text, position, _ = suffixes.anchors(*words(pa.array(texts)), 12, 5)
    for k, t in enumerate(texts):
        own = {int(p) for i, p in zip(text, position) if i == k}
        for i in range(len(t.split()) - 11):
            assert any(i <= p <= i + 7 for p in own)


@pytest.mark.parametrize("seed, many", [(1, False), (2, False), (3, True)])
def test_spans_as_brute_force(spark, seed, many, monkeypatch):
    if many:  # anchors with more rows than are held at a time
        monkeypatch.setattr(suffixes, "READS", 8)
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (12, 15, 30)]
    rows = []
    for d in range(60):
        parts = [sentence(rng, rng.randint(0, 25)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        if d % 7 == 0:
            parts += [rng.choice(shared)] * 2
        rows.append((d, " ".join(parts)))
    want = {k[0]: v for k, v in brute(rows, 12).items() if v}
    got = {}
    for r in suffixes.spans(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5).collect():
        assert not got.setdefault(r.doc_id, set()) & set(range(r.start_word, r.end_word))
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.first_doc_id <= r.doc_id
    assert got == want


def test_repetitive_texts(spark):
    rows = [(1, "a " * 300), (2, "a b " * 200), (3, "b a " * 100), (4, "a " * 300)]
    want = {k[0]: v for k, v in brute(rows, 12).items() if v}
    got = {}
    for r in suffixes.spans(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


def test_all_documents_as_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, start_word, end_word, first_doc_id FROM ({suffixes.ORACLE})").fetchall())
    got = sorted(map(tuple, suffixes.query(spark, sf_dir).select("doc_id", "start_word", "end_word", "first_doc_id").collect()))
    assert got == want and got


def test_cutting():
    assert suffixes.without("a b  c\nd e", [1], [3]) == "a d e"
    assert suffixes.without("a b c", [1], [3]) == "a" and suffixes.without("a b c ", [0], [3]) == ""
    assert suffixes.without(" a b c d", [3, 0], [4, 1]) == " b c"


def test_kept_documents(spark):
    rng = random.Random(9)
    passage = sentence(rng, 60)
    rows = [(1, "x1 " + passage + " y1.", "en", 0), (2, "x2\n" + passage + "\ny2.", "en", 0), (3, passage, "en", 0), (4, "alone", None, 7), (4, "alone", None, 7)]
    got = sorted(map(str, suffixes.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")).collect()))
    assert got == sorted(map(str, spark.createDataFrame([rows[0], (2, "x2\ny2.", "en", 6), rows[3], rows[4]], "doc_id long, text string, lang string, n_chars int").collect()))


def test_odd_documents(clashing, odd_rows, none):
    got = [tuple(r) for r in suffixes.spans(clashing).select("doc_id", "start_word", "end_word", "first_doc_id").collect()]
    assert got == [(5, 0, 120, 1)]
    kept = suffixes.keep(clashing)
    assert kept.schema == clashing.schema
    want = [r for r in odd_rows if r[0] != 5]
    assert sorted(map(str, (tuple(r)[:5] for r in kept.collect()))) == sorted(map(str, want))
    assert suffixes.keep(none).count() == 0 == suffixes.spans(none).count()


def test_null_ids(spark):
    body = sentence(random.Random(3), 70)
    rows = [(None, body), (8, body + " z")]
    got = [tuple(r) for r in suffixes.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "start_word", "end_word", "first_doc_id").collect()]
    assert got == [(None, 0, 70, 8)]
