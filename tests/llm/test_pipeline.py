from itertools import accumulate

import corpus_pipeline
from ngramforge.llm import bpe, language, packing, suffixes
from tests.llm import test_packing as packed
from tests.llm.test_minhash import brute as groups
from tests.llm.test_suffixes import brute as repeated


def reread(spark, frame, path):
    frame.write.parquet(path)
    return spark.read.parquet(path)


def stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = reread(spark, stage(spark, docs, sf_dir), str(tmp_path / name))
        out.append(docs)
    return out


def test_every_stage_as_brute_force(spark, sf_dir, tmp_path):
    docs, known, unique, cut, windows = stages(spark, sf_dir, tmp_path)
    assert known.columns == unique.columns == cut.columns == docs.columns

    # Language ID: each document by itself gets the verdict that it got among others.
    import pyarrow as pa

    model = language.fit(docs)
    found = {r.doc_id: r.lang for r in known.collect()}
    for r in docs.collect():
        _, lang, margin, letters = model.predict(pa.array([r.text or ""]))
        accepted = letters[0] >= language.LETTERS and margin[0] >= language.MARGIN
        assert found.get(r.doc_id) == (lang[0] if accepted else None)

    # Near duplicates: one of each group of all pairs' comparison.
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    first = {}
    for (doc_id, _), g in zip(rows, groups(rows)[0]):
        first[g] = min(first.get(g, doc_id), doc_id)
    kept = {r.doc_id for r in unique.collect()}
    assert kept >= set(first.values()) and len(kept) <= 1.02 * len(first)
    assert {r.doc_id: tuple(r) for r in unique.collect()} == {r.doc_id: tuple(r) for r in known.collect() if r.doc_id in kept}

    # Repeated passages: every word that a window seen before covers is gone, no other.
    rows = sorted((r.doc_id, r.text) for r in unique.collect())
    covered = repeated(rows, suffixes.PASSAGE)
    want = {d: " ".join(w for i, w in enumerate(t.split()) if i not in covered[d, t]) for d, t in rows}
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: " ".join(r.text.split()) for d, r in got.items()} == {d: t for d, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for d, r in got.items() if covered[d, dict(rows)[d]])

    # Packing: the texts whole and in order, at the least cost in each shard.
    made = sorted(windows.collect(), key=lambda r: (r.shard, r.window))
    assert {d: "".join(x) for d, x in packed.whole(made).items()} == {d: r.text for d, r in got.items()}
    with open(bpe.RANKS, "rb") as file:
        coder = bpe.coder(file.read())
    by = {}
    for r in made:
        by.setdefault(r.shard, []).append(r)
    want = packed.shards(cut, packing.SHARD_DOCS)
    assert [sorted({d for r in own for d in r.doc_ids}) for own in by.values()] == want
    for own, members in zip(by.values(), want):
        parts = [packed.units(coder, got[d].text, packing.LENGTH) for d in members]
        sizes, penalties = ([int(x) for p in parts for x in p[k]] for k in (0, 2))
        ends = [k for k, at in enumerate(accumulate(sizes), 1) if at in set(accumulate(r.n_tokens for r in own))]
        assert packed.cost(ends, sizes, penalties, packing.LENGTH) == packed.least(sizes, penalties, packing.LENGTH)

    # The whole at once gives the same rows.
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, windows.collect()))


def test_odd_tables(spark, odd, clashing, none, tmp_path):
    for name, frame in (("odd", odd), ("clashing", clashing), ("none", none)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        every = stages(spark, str(tmp_path / name), tmp_path / name)
        assert all(x.columns == frame.columns for x in every[:-1])
        assert (every[-1].count() > 0) == (name != "none")


def test_stages_are_named():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "packed_windows"]
