"""A model of n-grams: counts, and the lazily planned statistics over them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ngramforge.functions import keys
from ngramforge.functions.names import column, unused
from ngramforge.operators import counts as C
from ngramforge.operators import stats as S
from ngramforge.operators import windows as W

DEFAULT_LENGTH = 5


class NgramModel:
    """Counts of n-grams up to default_ngram_length tokens; models are values, adding gives a new one."""

    def __init__(self, spark: SparkSession, default_ngram_length: int = DEFAULT_LENGTH, counts: DataFrame | None = None, sentences: DataFrame | None = None, steps: tuple[tuple, ...] | None = None):
        if not isinstance(default_ngram_length, int) or default_ngram_length < 1:
            raise ValueError("default_ngram_length is an int from 1 on")
        self.spark = spark
        self.default_ngram_length = default_ngram_length
        #: What counts come from, as windows.folded() has it.
        self._steps = steps if steps is not None else () if counts is None else (("counts", counts),)
        #: What counts are of, where that is one corpus with n-grams of one length: its windows then give the statistics.
        self._sentences = sentences

    @cached_property
    def counts(self) -> DataFrame:
        """(k, ngram, count, back_count)."""
        steps = self._steps
        if not steps:
            return self.spark.createDataFrame([], "k int, ngram string, count long, back_count long")
        if steps[-1][0] == "prune":
            return C.prune(NgramModel(self.spark, self.default_ngram_length, steps=steps[:-1]).counts, steps[-1][1])
        if len(steps) > 1:
            return W.folded(steps)
        return steps[0][1] if steps[0][0] == "counts" else W.count(*steps[0][1:])

    # Training

    @classmethod
    def fit(cls, sentences: DataFrame, default_ngram_length: int = DEFAULT_LENGTH, longest: int | None = None) -> NgramModel:
        """Model of sentences (tokens array<string>, freq, ngram_length; the latter two may be absent)."""
        one = longest is None and "ngram_length" not in sentences.columns and default_ngram_length > 1
        step = ("sentences", C.padded(sentences, default_ngram_length), longest or default_ngram_length)
        return cls(sentences.sparkSession, default_ngram_length, sentences=sentences if one else None, steps=(step,))

    def add(self, sentences: DataFrame, longest: int | None = None) -> NgramModel:
        """The model with more sentences; statistics are those of all."""
        return self._after(("sentences", C.padded(sentences, self.default_ngram_length), longest or self.default_ngram_length))

    def add_sentence(self, sentence: Sequence[str], freq: int = 1, ngram_length: int | None = None) -> NgramModel:
        """The model with one sentence more, of a list, tuple or string (a token for each character)."""
        if freq <= 0:
            raise ValueError("freq is 1 or more")
        if not sentence:
            return self
        row = self.spark.createDataFrame([(list(sentence), freq, ngram_length)], "tokens array<string>, freq long, ngram_length int")
        return self.add(row, max(self.default_ngram_length, ngram_length or 0))

    def merge(self, other: NgramModel) -> NgramModel:
        pruned = any(step[0] == "prune" for step in other._steps)
        return self._after(*([("counts", other.counts)] if pruned else other._steps))

    def prune(self, q: int = 1) -> NgramModel:
        return self._after(("prune", q))

    def clear(self) -> NgramModel:
        return NgramModel(self.spark, self.default_ngram_length)

    def _after(self, *steps: tuple) -> NgramModel:
        return NgramModel(self.spark, self.default_ngram_length, steps=(*self._steps, *steps))

    def persist(self) -> NgramModel:
        """Keeps counts: both directions' entropies and all lookups read them."""
        self.counts = self.counts.persist()
        self._steps = (("counts", self.counts),)
        return self

    # Read forwards: the leaves, and what the variants of pruning leave

    def leaves(self) -> DataFrame:
        """(k, ngram, count) of the n-grams that no longer one continues."""
        return C.leaves(self.counts).select("k", "ngram", "count") if self._sentences is None else self._trimmed(W.LEAVES)

    def pruned_leaves(self, q: int = 1) -> DataFrame:
        """(k, ngram, count) as C.prune_leaves()."""
        return C.prune_leaves(self.counts, q) if self._sentences is None else self._trimmed(W.LEAFWISE, q)

    def pruned_hapax(self) -> DataFrame:
        """(k, ngram, count) as C.prune_hapax()."""
        return C.prune_hapax(self.counts) if self._sentences is None else self._trimmed(W.HAPAX)

    def _trimmed(self, rule: str, q: int = 1) -> DataFrame:
        return W.trimmed(C.padded(self._sentences, self.default_ngram_length), self.default_ngram_length, rule, q)

    # Statistics

    @cached_property
    def _corpus(self) -> W.Corpus | None:
        return None if self._sentences is None else W.Corpus(C.padded(self._sentences, self.default_ngram_length), self.default_ngram_length)

    @cached_property
    def depth(self) -> int:
        if self._sentences is not None:
            return self.default_ngram_length
        return max(self.default_ngram_length, C.max_depth(self.counts).first()[0])

    def entropies(self) -> DataFrame:
        """(back, k, ngram, entropy) of every n-gram with children in a direction, the empty one included."""
        return S.entropies(self.counts) if self._corpus is None else self._corpus.entropies()

    def normalisation(self) -> DataFrame:
        """(direction, k, mean, stdev)."""
        known = S.norms(S.variations(S.entropies(self.counts))) if self._corpus is None else S.pooled(self._corpus.varied(), self._corpus.lone())
        norms = S.every_length(known, self.depth)
        return norms.select(F.when(F.col("back"), "backward").otherwise("forward").alias("direction"), "k", "mean", "stdev")

    @cached_property
    def measures(self) -> DataFrame:
        """(k, ngram, count, entropy, ev, autonomy, centred) of n-grams with children in both directions, the empty one included."""
        return S.averaged(self.counts) if self._corpus is None else S.measured(self._corpus.varied(), self._corpus.lone())

    @property
    def scores(self) -> DataFrame:
        """measures without the empty n-gram."""
        return self.measures.where("k > 0")

    def mean_entropies(self) -> DataFrame:
        """(k, ngram, entropy) of scores; of a corpus they need no shorter n-grams, whose shuffle is left out."""
        if self._corpus is None:
            return self.scores.select("k", "ngram", "entropy")
        both = self._corpus.both().where("k > 0 AND h IS NOT NULL AND back_h IS NOT NULL")
        return both.select("k", "ngram", ((F.col("h") + F.col("back_h")) / 2).alias("entropy"))

    def root_entropy(self) -> DataFrame:
        """(entropy) of the empty n-gram, the mean of both directions."""
        found = S.entropies(self.counts.where("k = 1")).where("k = 0").agg(F.avg("entropy").alias("entropy"), F.count("*").alias("sides"))
        return found.where("sides = 2").select("entropy")

    # Lookups

    def query(self, ngrams: DataFrame) -> DataFrame:
        """ngrams (ngram array<string>) with count, entropy, ev, autonomy and centred; an n-gram that is not known has count 0 and NULLs."""
        k, g, node = unused(ngrams, "_k", "_g", "_node")
        asked = ngrams.withColumn(k, F.size("ngram")).withColumn(g, keys.key(F.col("ngram")))
        few = asked.select(F.col(k).alias("k"), F.col(g).alias("ngram"))
        known = W.narrowed(self.counts.where("count > 0"), few).select(F.col("k").alias(k), F.col("ngram").alias(g), F.col("count").alias(node))
        scores = W.narrowed(self.measures, few).select(F.col("k").alias(k), F.col("ngram").alias(g), *S.MEASURES)
        out = asked.join(known, [k, g], "left").join(scores, [k, g], "left")
        return out.withColumn("count", F.coalesce(node, F.lit(0))).select(*map(column, ngrams.columns), "count", *S.MEASURES)

    def _one(self, ngram: Sequence[str], measure: str) -> float | None:
        row = self.spark.createDataFrame([(list(ngram),)], "ngram array<string>")
        return self.query(row).first()[measure]

    def query_count(self, ngram: Sequence[str]) -> int:
        found = self.counts.where((F.col("k") == len(ngram)) & (F.col("ngram") == keys.literal(ngram))).agg(F.sum("count")).first()[0]
        return found or 0

    def query_entropy(self, ngram: Sequence[str]) -> float | None:
        return self._one(ngram, "entropy")

    def query_ev(self, ngram: Sequence[str]) -> float | None:
        return self._one(ngram, "ev")

    def query_autonomy(self, ngram: Sequence[str], z_score: bool = True) -> float | None:
        return self._one(ngram, "autonomy" if z_score else "centred")

    def vocabulary(self, markers: bool = True) -> DataFrame:
        """(ngram array<string>, count)."""
        return C.vocabulary(self.counts, markers).select(keys.tokens(F.col("ngram"), F.col("k")).alias("ngram"), "count")

    def lexicon(self, voc: DataFrame | None = None, longest: int | None = None, markers: bool = True) -> DataFrame:
        """(ngram array<string>, autonomy, count) of the n-grams with an autonomy, of voc (ngram array<string>) where one is given.

        Those of up to longest tokens without markers are the slices of the model's own sentences: no voc is needed for them.
        """
        known = self.measures.where("autonomy IS NOT NULL AND count > 0")
        if longest is not None:
            known = known.where(F.col("k") <= longest)
        if not markers:
            known = known.where(C.unmarked("ngram"))
        if voc is not None:
            asked = voc.select(F.size("ngram").alias("k"), keys.key(F.col("ngram")).alias("ngram")).distinct()
            known = known.join(asked, ["k", "ngram"], "left_semi")
        return known.select(keys.tokens(F.col("ngram"), F.col("k")).alias("ngram"), "autonomy", "count")

    # Storage

    def save(self, path: str) -> None:
        """Writes counts as Parquet, with the n-gram length beside them."""
        self.counts.withColumn("length", F.lit(self.default_ngram_length)).write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(json.dumps({"default_ngram_length": self.default_ngram_length}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramModel:
        """The model as it was saved, with its n-gram length."""
        meta = json.loads(spark.read.text(f"{path}.meta").first()[0])
        return cls(spark, meta["default_ngram_length"], spark.read.parquet(path).select(*C.COUNTS))
