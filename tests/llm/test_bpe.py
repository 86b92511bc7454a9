import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ngramforge.llm import bpe


@pytest.fixture(scope="module")
def coder():
    with open(bpe.RANKS, "rb") as file:
        return bpe.ByteBPE(file.read())


ODD = st.text(st.one_of(st.sampled_from(list(" \n\t'.,-aZé中　​1\U0001f600s")), st.characters(codec="utf-8")), max_size=300)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(1, 40))
def test_tree_equals_flat(text, leaf):
    coder = bpe.coder(open(bpe.RANKS, "rb").read())
    want = coder.flat(text)
    assert np.array_equal(coder.encode(text, leaf), want)
    assert coder.decode(want) == text
    offsets, ids = coder.encode_all(pa.array([text, "", text + " x"]))
    assert np.array_equal(ids[: offsets[1]], want) and offsets[1] == offsets[2]


def test_joining_is_associative(coder):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abé'.,") for _ in range(rng.randint(1, 9))) for _ in range(60))
    n = len(text)
    for _ in range(40):
        a, b = sorted(rng.sample(range(1, n), 2))
        x, y, z = coder.flat(text[:a]), coder.flat(text[a:b]), coder.flat(text[b:])
        left = coder.join(text, 0, b, n, coder.join(text, 0, a, b, x, y), z)
        right = coder.join(text, 0, a, n, x, coder.join(text, a, b, n, y, z))
        assert np.array_equal(left, right) and np.array_equal(left, coder.flat(text))


def test_long_texts(coder):
    rng = random.Random(3)
    for text in ("x" * 100_000, " " * 50_000, "ab " * 60_000, "".join(rng.choice("abcdefghij kl") for _ in range(300_000)), "中" * 40_000):
        ids = coder.encode_all(pa.array([text]))[1]
        assert coder.decode(ids) == text
        assert np.array_equal(ids, coder.flat(text))


def test_all_documents(spark, sf_dir, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.decoded_ok and r.ids == coder.flat(texts[r.doc_id]).tolist() and r.n_tokens == len(r.ids) for r in got)


def test_odd_documents(clashing, odd_rows, none):
    got = bpe.encode_documents(clashing).collect()
    assert sorted((str(r.doc_id), r.n_tokens is None, bool(r.ids)) for r in got) == sorted((str(d), t is None, bool(t)) for d, t, *_ in odd_rows)
    assert all(r.decoded_ok in (True, None) and (r.decoded_ok is None) == (r.ids is None) for r in got)
    assert bpe.encode_documents(none).count() == 0
