import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ngramforge.llm import bpe, packing, ranges


def least(sizes, penalties, length):
    """Least cost over all ways to cut, by quadratic dynamic programming."""
    best = [0]
    for j in range(1, len(sizes) + 1):
        ways, total = [], 0
        for i in range(j - 1, -1, -1):
            total += sizes[i]
            if total > length:
                break
            ways.append(best[i] + length - total)
        best.append(min(ways) + penalties[j - 1])
    return best[-1]


def cost(ends, sizes, penalties, length):
    at = out = 0
    for end in ends:
        n = sum(sizes[at:end])
        assert 0 < n <= length
        out += length - n + penalties[end - 1]
        at = end
    assert at == len(sizes)
    return out


def test_cuts_are_the_best():
    rng = random.Random(1)
    for _ in range(500):
        length = rng.randint(1, 12)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 25))]
        penalties = [rng.choice([0, 0, 2, 5]) for _ in sizes]
        assert cost(packing.cuts(sizes, penalties, length), sizes, penalties, length) == least(sizes, penalties, length)


@pytest.fixture(scope="module")
def coder():
    with open(bpe.RANKS, "rb") as file:
        return bpe.coder(file.read())


def units(coder, text, length):
    """packing.units() of a text."""
    return packing.units(text.encode(), np.cumsum(coder.size[coder.flat(text)]), length)


def plain(coder, text, length):
    """(tokens, penalty) of the units, token by token."""
    ends, out, at = [], [], 0
    stops = [len(text[: m.end()].encode()) for m in re.finditer(r"(?<=[.!?…])\s+|\n\s*|(?<=[。！？])\s*", text, re.A)]
    for token in coder.flat(text).tolist():
        at += len(coder.bytes[token])
        ends.append(at)
    starts = {len(text[:i].encode()) for i in range(len(text) + 1)} if len(text) < 3000 else None
    whole = [starts is None or e in starts for e in ends]
    held = 0
    for i, end in enumerate(ends):
        held += 1
        # Not the next token, and none that ends within the sentence and with a character, may come before the stop.
        later = [e for e, w in zip(ends[i + 1 :], whole[i + 1 :]) if w]
        if whole[i] and (not later or any(end <= s < later[0] for s in stops)):
            while held > length:
                out.append((length, packing.INNER_CUT))
                held -= length
            out.append((held, packing.SENTENCE_CUT))
            held = 0
    if out:
        out[-1] = (out[-1][0], 0)
    return out


def test_units(coder):
    for text in ("One two. Three four five! six\nseven", "Eins.  Zwei? \n\n drei…vier… fünf", "我爱北京。他很好！大？是 的\n好", "x", "a.b.c", ". . .", "  lead. in"):
        sizes, ends, costs = units(coder, text, 50)
        assert list(zip(sizes.tolist(), costs.tolist())) == plain(coder, text, 50) and ends[-1] == len(text.encode())
    sizes, ends, costs = units(coder, "One two. Three four five! six", 50)
    assert [b.decode() for b in (b"One two.", b" Three four five!", b" six")] == ["One two. Three four five! six"[a:b] for a, b in zip([0, *ends], ends)]
    sizes, ends, costs = units(coder, "word " * 25, 10)
    assert sizes.tolist() == [10, 10, 6] and costs.tolist() == [packing.INNER_CUT] * 2 + [0]
    for text in ("中" * 3000, "我爱北京。" * 900, "😀" * 500):
        sizes, ends, costs = units(coder, text, 64)
        assert sizes.max() <= 64 and sizes.sum() == len(coder.flat(text))
        assert "".join(text.encode()[a:b].decode() for a, b in zip([0, *ends], ends)) == text
    assert (units(coder, "我爱北京。" * 900, 64)[2] == packing.SENTENCE_CUT).sum() == 899
    assert len(units(coder, "", 5)[0]) == 0


def whole(windows):
    """Texts put together again by document, in order of windows."""
    out = {}
    for r in sorted(windows, key=lambda r: (r.shard, r.window)):
        for d, t in zip(r.doc_ids, r.texts, strict=True):
            out.setdefault(d, []).append(t)
    return out


def shards(docs, shard_docs):
    """Ids of the documents with a text, in order, by shard."""
    kept = docs.where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    mark = F.xxhash64(F.lit(False), "doc_id", F.xxhash64("text"))
    out = [[]]
    for r in kept.select("doc_id", (mark % shard_docs == 0).alias("starts")).orderBy("doc_id").collect():
        if r.starts and out[-1]:
            out.append([])
        out[-1].append(r.doc_id)
    return out


@pytest.mark.parametrize("length, shard_docs", [(64, 16), (packing.LENGTH, packing.SHARD_DOCS)])
def test_all_documents(spark, sf_dir, coder, length, shard_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and r.text.strip()}
    got = sorted(packing.pack(docs, length, shard_docs).collect(), key=lambda r: (r.shard, r.window))
    assert {d: "".join(t) for d, t in whole(got).items()} == texts
    assert all(0 < r.n_tokens <= length and r.n_tokens + r.padding == length and r.doc_ids == sorted(r.doc_ids) for r in got)
    ids = [d for r in got for d in r.doc_ids]
    assert ids == sorted(ids)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    want = shards(docs, shard_docs)
    assert [sorted({d for r in own for d in r.doc_ids}) for own in by.values()] == want
    for own, members in zip(by.values(), want):
        assert [r.window for r in own] == list(range(len(own)))
        parts = [units(coder, texts[d], length) for d in members]
        sizes, penalties = (np.concatenate([p[i] for p in parts]).tolist() for i in (0, 2))
        total = np.cumsum(sizes).tolist()
        ends = [total.index(t) + 1 for t in np.cumsum([r.n_tokens for r in own]).tolist()]
        assert cost(ends, sizes, penalties, length) == least(sizes, penalties, length)


def test_windows_hold_the_tokens_of_the_coder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = {r.doc_id: r.n_tokens for r in bpe.query(spark, sf_dir).select("doc_id", "n_tokens").collect()}
    got = packing.query(spark, sf_dir).collect()
    assert sum(r.n_tokens for r in got) == sum(n[r.doc_id] for r in docs.where(F.col("text").rlike(r"\S")).select("doc_id").collect())
    assert sum(r.padding for r in got) < 0.1 * sum(r.n_tokens for r in got)


def test_windows_do_not_depend_on_ids_and_ranges(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = lambda rows: sorted((r.n_tokens, tuple(r.texts)) for r in rows)
    dense = packing.pack(docs, 256, 16).collect()
    far = packing.pack(docs.withColumn("doc_id", F.col("doc_id") * 2**40), 256, 16).collect()
    assert abs(len(far) - len(dense)) < 0.05 * len(dense)
    assert content(packing.pack(docs.repartition(7, "source"), 256, 16).collect()) == content(dense)
    for bounds in (4, 0):
        monkeypatch.setattr(ranges, "BOUNDS", bounds)
        assert content(packing.pack(docs, 256, 16).collect()) == content(dense)
    nobody = packing.pack(docs.withColumn("doc_id", F.lit(None).cast("long")), 256, 16).collect()
    assert len({r.shard for r in nobody}) > 3 and abs(len(nobody) - len(dense)) < 0.05 * len(dense)


def test_odd_documents(spark, clashing, odd_rows, none, coder):
    got = packing.pack(clashing, 100).collect()
    texts = {}
    for d, t, *_ in odd_rows:
        if t and t.strip():
            texts.setdefault(d, []).append(t)
    assert {d: "".join(t) for d, t in whole(got).items()} == {d: "".join(t) for d, t in texts.items()}
    assert all(r.n_tokens <= 100 for r in got)
    assert packing.pack(none).count() == 0
    chinese = spark.createDataFrame([(1, "北京很大。" * 5000), (2, "中" * 20_000)], "doc_id long, text string")
    got = packing.pack(chinese, 128).collect()
    assert max(r.n_tokens for r in got) <= 128 and {d: "".join(t) for d, t in whole(got).items()} == {1: "北京很大。" * 5000, 2: "中" * 20_000}
    with pytest.raises(ValueError):
        packing.pack(chinese, 3)
