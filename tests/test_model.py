"""Counts, statistics and lookups on small corpora with known values."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ngramforge.functions import keys
from ngramforge.functions.keys import END, START
from ngramforge.operators import counts as C
from ngramforge.operators import stats as S
from ngramforge.plans.model import NgramModel

CITY = ["potatoes are fine", "I like potatoes", "New York is a fine city", "I like New York city"]
CATS = ["crazy dog", "big black cat", "super small red cat", "very small black cat"]


def fit(spark, lines, n, freq=None):
    rows = [(line.split(), (freq or {}).get(line, 1)) for line in lines]
    return NgramModel.fit(spark.createDataFrame(rows, "tokens array<string>, freq long"), n)


def W(line):
    return line.split()


def near(a, b, tolerance=1e-4):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= tolerance


def test_cities(spark):
    model = fit(spark, CITY, 5)
    asked = spark.createDataFrame([(x.split(),) for x in ("New York", "like potatoes", "New potatoes", "I like potatoes", "potatoes")], "ngram array<string>")
    got = {" ".join(r.ngram): r for r in model.query(asked).collect()}
    assert {g: r["count"] for g, r in got.items()} == {"New York": 2, "New potatoes": 0, "I like potatoes": 1, "potatoes": 2, "like potatoes": 1}
    assert near(got["New York"].autonomy, 2.03699779, 1e-6)
    assert near(got["like potatoes"].autonomy, -0.32270229, 1e-6)
    assert got["New potatoes"].autonomy is None


def test_cats(spark):
    model = fit(spark, CATS, 3)
    assert [model.query_count(x.split()) for x in ("cat", "black cat", "very small black cat")] == [3, 2, 0]
    assert near(model.query_autonomy(W("black cat")), 1.9537)
    assert near(model.query_autonomy(W("small black")), -0.1965)
    assert model.query_autonomy(W("small black cat")) is None


def test_weights(spark):
    model = fit(spark, ["le petit chien", "pour le petit", "le petit chat"], 5, {"pour le petit": 2})
    assert model.query_count(W("le petit")) == 4 and model.query_count(["pour"]) == 2
    assert near(model.query_entropy(W("le petit")), 1.75)
    assert near(model.query_autonomy(W("le petit")), 1.89582)


def test_adding_and_clearing(spark):
    model = NgramModel(spark).add_sentence(W("un petit petit petit chat danse la samba"))
    assert model.default_ngram_length == 5
    model = model.add_sentence(ngram_length=2, sentence=W("it is very very very cool"))
    asked = ("un petit petit petit chat", "un petit petit petit chat danse", "very cool", "very very cool")
    assert [model.query_count(x.split()) for x in asked] == [1, 0, 1, 0]
    assert model.clear().query_count(["petit"]) == 0
    assert model.clear().query_autonomy(["petit"]) is None
    assert model.add_sentence([]) is model
    again = model.clear().add_sentence(("le", "sac", "jaune")).add_sentence(freq=3, sentence=W("le sac rouge"))
    assert again.query_count(["le"]) == 4 and again.query_count(W("sac rouge")) == 3
    for bad in (0, -1):
        with pytest.raises(ValueError):
            model.add_sentence(["x"], freq=bad)
    with pytest.raises(PySparkException):
        C.count(spark.createDataFrame([(["x"], -2)], "tokens array<string>, freq long"), 2).collect()
    with pytest.raises(ValueError):
        NgramModel(spark, 0)


def test_characters_of_a_string(spark):
    model = NgramModel(spark, 3).add_sentence("abab")
    assert model.query_count("ab") == 2 and model.query_count(W("b a")) == 1


def test_markers(spark):
    model = NgramModel(spark).add_sentence(W("le petit chat"))
    assert model.query_count([START]) == 1 and model.query_count([END]) == 0
    assert model.query_count([]) == 4
    back = model.counts.where(F.col("ngram") == END).first()
    assert back.back_count == 1


def test_keys_keep_odd_tokens_apart(spark):
    odd = ["a", "", "\x1f", "\x1e", "\x1e1", "a\x1fb", " "]
    model = NgramModel.fit(spark.createDataFrame([(odd,)], "tokens array<string>"), 2)
    asked = spark.createDataFrame([(odd[i : i + k],) for k in (1, 2) for i in range(len(odd) - k + 1)], "ngram array<string>")
    assert {r["count"] for r in model.query(asked).collect()} == {1}
    found = {tuple(r.ngram) for r in model.vocabulary(markers=False).collect()}
    assert found == {tuple(odd[i : i + k]) for k in (1, 2) for i in range(len(odd) - k + 1)}
    back = model.counts.where("k = 2").select(keys.tokens(F.col("ngram"), F.col("k")).alias("t"), keys.tokens(keys.prefix("ngram", "k"), F.lit(1)).alias("p"), keys.tokens(keys.suffix("ngram", "k"), F.lit(1)).alias("s")).collect()
    assert all([r.p[0], r.s[0]] == r.t for r in back)


def test_bare_store(spark):
    rows = spark.createDataFrame([(W("1 2 4"),), (W("1 2 5"),), (W("1 2 6"),), (W("1 3 6"),)], "ngram array<string>")
    counts = C.count_ngrams(rows)
    found = {(r.k, r.ngram): r["count"] for r in counts.collect()}
    assert found[2, keys.literal(W("1 2"))] == 3 and found[0, ""] == 4
    entropy = {r.ngram: r.entropy for r in S.direction(S.entropies(counts, terminals=())).collect()}
    assert near(entropy[keys.literal(W("1 2"))], math.log2(3)) and entropy[""] == 0.0
    scored = {r.ngram: r.autonomy for r in S.direction(S.scored(S.variations(S.entropies(counts, terminals=())))).collect()}
    assert near(scored[keys.literal(W("1 2"))], 1.0)
    two = C.count_ngrams(rows.limit(2))
    assert [(r["mean"], r.stdev) for r in S.direction(S.norm_vector(S.variations(S.entropies(two, terminals=())), 3)).orderBy("k").collect()] == [(0, 0), (1, 0), (0, 0)]
    assert C.max_depth(counts).first()[0] == 3
    empty = C.count_ngrams(spark.createDataFrame([([],), ([],)], "ngram array<string>"))
    assert empty.count() == 0 and C.max_depth(empty.select(*C.COUNTS)).first()[0] == 0


class Plain:
    """The same measures by nested loops, both directions apart."""

    def __init__(self, sentences, n):
        self.count = ({}, {})
        for tokens in sentences:
            for d, row in enumerate(([START, *tokens, END], [START, *tokens, END][::-1])):
                for i in range(len(row) - 1):
                    for k in range(n + 1):
                        if i + k <= len(row):
                            g = tuple(row[i : i + k])
                            self.count[d][g] = self.count[d].get(g, 0) + 1
        self.entropy = ({}, {})
        for d, count in enumerate(self.count):
            below = {}
            for g, c in count.items():
                if g:
                    below.setdefault(g[:-1], []).append((g[-1], c))
            for g, own in below.items():
                total = sum(c for _, c in own)
                self.entropy[d][g] = sum(c / total * (math.log2(total) if t in (START, END) else -math.log2(c / total)) for t, c in own)

    def ev(self, d, g):
        h, above = self.entropy[d].get(g), self.entropy[d].get(g[:-1])
        return None if h is None or h == above == 0 else h - above

    def autonomy(self, g):
        both = []
        for d, own in enumerate((g, g[::-1])):
            every = [e for x in self.count[d] if len(x) == len(g) and (e := self.ev(d, x)) is not None]
            here = self.ev(d, own) if own in self.count[d] else None
            if here is None or not every:
                return None
            mean = sum(every) / len(every)
            stdev = math.sqrt(sum((e - mean) ** 2 for e in every) / len(every))
            if stdev < 1e-12:
                return None
            both.append((here - mean) / stdev)
        return sum(both) / 2


@pytest.mark.parametrize("n", [2, 4])
def test_random_corpora(spark, n):
    rng = random.Random(n)
    sentences = [[str(int(rng.paretovariate(0.8))) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    plain = Plain(sentences, n)
    model = NgramModel.fit(spark.createDataFrame([(s,) for s in sentences], "tokens array<string>"), n).persist()
    asked = sorted({tuple(s[i : i + k]) for s in sentences for k in range(1, n + 1) for i in range(len(s) - k + 1)} | {("nobody",)})
    got = {tuple(r.ngram): r for r in model.query(spark.createDataFrame([(list(g),) for g in asked], "ngram array<string>")).collect()}
    for g in asked:
        assert got[g]["count"] == plain.count[0].get(g, 0)
        assert near(got[g].autonomy, plain.autonomy(g), 1e-7), g
        a, b = plain.ev(0, g) if g in plain.count[0] else None, plain.ev(1, g[::-1]) if g in plain.count[0] else None
        assert near(got[g].ev, None if a is None or b is None else (a + b) / 2, 1e-9)


def test_pruning(spark):
    rows = [("a b c".split(), 3), ("a b d".split(), 1), ("e".split(), 2)]
    counts = C.count(spark.createDataFrame(rows, "tokens array<string>, freq long"), 3)
    before = {r.ngram: r["count"] for r in counts.collect()}
    pruned = {r.ngram: r["count"] for r in C.prune(counts, 2).where("count > 0").collect()}
    assert pruned == {g: c - 2 * (g != "") for g, c in before.items() if g == "" or c > 2}
    once = {r.ngram: r["count"] for r in C.prune_hapax(counts).collect()}
    at = lambda x: keys.literal(x.split())
    assert at("b d") not in once and once[at("a b")] == 3 and once[at("a b c")] == 3 and once[at("b")] == 3
    leafwise = {r.ngram: r["count"] for r in C.prune_leaves(counts).collect()}
    assert leafwise[at("a b")] == 2 and leafwise[at("a b c")] == 2 and at("a b d") not in leafwise
    assert {tuple(r.g) for r in C.leaves(counts).select(keys.tokens(F.col("ngram"), F.col("k")).alias("g")).collect()} >= {("a", "b", "c"), ("a", "b", "d")}


def test_merging_is_training_on_all(spark):
    one, two = fit(spark, CITY[:2], 3), fit(spark, CITY[2:], 3)
    rows = lambda m: sorted(map(tuple, m.counts.collect()))
    assert rows(one.merge(two)) == rows(fit(spark, CITY, 3))


def test_nothing(spark):
    model = NgramModel.fit(spark.createDataFrame([([],), (None,)], "tokens array<string>"), 3)
    assert model.counts.count() == 0 and model.scores.count() == 0 and model.query_count(["x"]) == 0
    assert model.lexicon().count() == 0


def test_saving(spark, tmp_path):
    model = fit(spark, CATS, 3)
    path = str(tmp_path / "model")
    model.save(path)
    again = NgramModel.load(spark, path)
    assert again.default_ngram_length == 3 and near(again.query_autonomy(W("black cat")), 1.9537)
    grown = again.add_sentence(W("black cat"))
    grown.save(path + "2")
    assert NgramModel.load(spark, path + "2").query_count(W("black cat")) == 3
