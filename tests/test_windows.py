import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ngramforge.functions import keys
from ngramforge.operators import counts as C
from ngramforge.operators import lexicon
from ngramforge.operators import windows as W
from ngramforge.plans.model import NgramModel
from ngramforge.sources import corpora


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def _odd(spark):
    rows = [
        (["a", "", "b\x1f", "b\x1e", None, "é"], 5, 3),
        ([], 1, 2),
        (None, 1, 1),
        (["a"], 2, 1),
        (["a", "b", "a", "b"], 2**40, None),
        (["x"] * 9, 1, 5),
        (["", "a", "", "b"], 3, 2),
    ]
    return spark.createDataFrame(rows, "tokens array<string>, freq long, ngram_length int")


def _sorted(counts):
    return sorted(map(tuple, counts.select(*C.COUNTS).collect()))


@pytest.mark.parametrize(("length", "longest"), [(1, None), (3, None), (2, 5)])
def test_counts_of_windows_are_those_of_every_run(spark, length, longest):
    rows = C.padded(_odd(spark), length)
    every = C.summed(C.windows(rows, longest or length).unionByName(C.roots(rows)))
    found = C.count(_odd(spark), length, longest)
    assert _sorted(found) == _sorted(every)
    assert "hashpartitioning(k" not in _plan(found)


def test_no_windows_no_counts(spark):
    model = NgramModel.fit(_odd(spark).limit(0).drop("ngram_length"), 3)
    assert model.counts.count() == model.measures.count() == model.entropies().count() == 0


@pytest.mark.parametrize("length", [2, 3, 5])
def test_measures_of_windows_are_those_of_counts(spark, sf_dir, length):
    few = corpora.lines_of(corpora.table(spark, f"{sf_dir}/documents.parquet")).where("doc_id < 40").select("tokens", F.lit(1).alias("freq"))
    for rows in (_odd(spark).drop("ngram_length"), few):
        model = NgramModel.fit(rows, length)
        plain = NgramModel(spark, length, model.counts)
        for found, want, keys in (
            (model.measures, plain.measures, 3),
            (model.entropies(), plain.entropies(), 3),
            (model.normalisation(), plain.normalisation(), 2),
        ):
            a, b = ({tuple(r)[:keys]: tuple(r)[keys:] for r in x.collect()} for x in (found, want))
            assert a.keys() == b.keys()
            assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
        assert "hashpartitioning(back" not in _plan(model.measures)


def test_lookups_move_only_what_may_be_asked_for(spark, tmp_path):
    NgramModel.fit(spark.createDataFrame([([f"w{i}", f"w{i + 1}"],) for i in range(20_000)], "tokens array<string>"), 2).save(str(tmp_path / "model"))
    model = NgramModel.load(spark, str(tmp_path / "model"))
    spark.createDataFrame([(["w1"],), (["w1", "w2"],), (["none"],)], "ngram array<string>").write.parquet(str(tmp_path / "asked"))
    found = model.query(spark.read.parquet(str(tmp_path / "asked")))
    assert "LeftSemi" in _plan(found)
    assert sorted((tuple(r.ngram), r["count"]) for r in found.collect()) == [(("none",), 0), (("w1",), 2), (("w1", "w2"), 1)]


def test_blocks_leave_known_tokens_out():
    words = [f"word{i:05d}" for i in range(2_000)]
    sentences = [[words[(i * j) % 2_000] for j in range(1, 30)] for i in range(1, 400)]
    rows = pa.RecordBatch.from_arrays([pa.array(sentences), pa.array([1] * 399, pa.int64()), pa.array([3] * 399, pa.int32())], names=["tokens", "freq", "n"])
    sizes, tokens = [], []
    for known in (pa.array([], pa.string()), pa.array(words[:1_900])):
        blocks = list(W._windows(3, 64, known)(iter([rows])))
        sizes.append(sum(len(data) for b in blocks for data in b.column("data").to_pylist()))
        tokens.append({*W._received(iter(blocks), known)[0].to_pylist()})
    assert sizes[1] < 0.7 * sizes[0]
    assert tokens[1] == tokens[0] | {*words[:1_900]}


def test_mean_entropies_and_own_slices_need_no_further_shuffle(spark, sf_dir):
    few = corpora.lines_of(corpora.table(spark, f"{sf_dir}/documents.parquet")).where("doc_id < 40").select("tokens")
    model = NgramModel.fit(few, 3)
    entropies = model.mean_entropies()
    assert _plan(entropies).count("MapInArrow") < _plan(model.scores).count("MapInArrow")
    a, b = ({(r.k, r.ngram): r.entropy for r in x.collect()} for x in (entropies, model.scores))
    assert a == pytest.approx(b, abs=1e-9)
    own, asked = model.lexicon(longest=2, markers=False), model.lexicon(lexicon.candidates(few, 2))
    assert _plan(own).count("Exchange") < _plan(asked).count("Exchange")
    a, b = ({tuple(r.ngram): r["count"] for r in x.collect()} for x in (own, asked))
    assert a == b


def test_models_that_grow_are_folded_in_one_shuffle(spark):
    odd, more = _odd(spark), spark.createDataFrame([(["a", "b", "a"], 2), (["new", "\x1e\x1f", ""], 1)], "tokens array<string>, freq long")
    counted = C.count(odd, 3, 5), C.count(more, 3)
    bare = C.count_ngrams(spark.createDataFrame([(["a", "b"],), (["bare"],)], "ngram array<string>"))
    one, two = NgramModel.fit(odd, 3, 5), NgramModel.fit(more, 3)
    for found, want in (
        (one.merge(two), C.merge(*counted)),
        (one.prune(2).add(more), C.merge(C.prune(counted[0], 2), counted[1])),
        (one.merge(two.prune(1)).prune(1).merge(two), C.merge(C.prune(C.merge(counted[0], C.prune(counted[1], 1)), 1), counted[1])),
        (NgramModel(spark, 3, counted[0]).add(more), C.merge(*counted)),
        (NgramModel(spark, 3, bare).merge(two), C.merge(bare, counted[1])),
    ):
        assert _sorted_nulls(found.counts) == _sorted_nulls(want)
        assert found._steps[0][1] is bare or "hashpartitioning(k" not in _plan(found.counts)


def _sorted_nulls(counts):
    return sorted(map(tuple, counts.select(*C.COUNTS).collect()), key=repr)


@pytest.mark.parametrize("length", [2, 4])
def test_leaves_and_pruning_from_windows(spark, sf_dir, length):
    few = corpora.lines_of(corpora.table(spark, f"{sf_dir}/documents.parquet")).where("doc_id < 20").select("tokens", F.lit(1).alias("freq"))
    for rows in (_odd(spark).drop("ngram_length"), few, few.limit(0)):
        model = NgramModel.fit(rows, length)
        counts = model.counts.persist()
        for found, want in (
            (model.leaves(), C.leaves(counts).select("k", "ngram", "count")),
            (model.pruned_leaves(2), C.prune_leaves(counts, 2)),
            (model.pruned_hapax(), C.prune_hapax(counts)),
        ):
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
            assert "Join" not in _plan(found)


def test_long_models_move_no_settled_ngrams():
    """Hardly any of these n-grams of four tokens occurs twice; only those that may have an autonomy are moved."""
    draw = random.Random(1)
    rows = [[keys.START, *(f"w{draw.randrange(20)}" for _ in range(12)), keys.END] for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([1] * 120, pa.int64()), pa.array([5] * 120, pa.int32())], names=["tokens", "freq", "n"])
    of = W.Sample(pa.array([], pa.string()), pa.array(keys.MARKERS))
    blocks = list(W._windows(5, 1, of.known, True, of.frequent)(iter([batch])))
    found = {k: (len(at), int(settled.sum())) for k, at, *_, settled in W._Measured(iter(blocks), 5, of).ngrams()}
    _, columns, others = W._received(W._asked(5, 1, of)(iter(blocks)), of.known)
    moved = sum(len(c[0]) for c, o in zip(columns, others, strict=True) if o[0] == 4)
    assert found[1][1] == found[2][1] == 0
    assert moved == found[4][0] - found[4][1] < found[4][0] / 2
