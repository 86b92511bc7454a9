"""Lexicons: distinct n-grams in the order of their autonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ngramforge.functions.tokens import spans


def candidates(sentences: DataFrame, longest: int) -> DataFrame:
    """(ngram array<string>): the distinct slices of up to that many tokens."""
    return sentences.select(F.explode(spans(F.col("tokens"), longest)).alias("ngram")).distinct()


def ranked(lexicon: DataFrame) -> DataFrame:
    """A lexicon by falling autonomy; equal ones by their tokens."""
    return lexicon.where("autonomy IS NOT NULL").orderBy(F.desc("autonomy"), "ngram")


def formatted(lexicon: DataFrame, separator: str = " ") -> DataFrame:
    """(value): tokens, a tab and the autonomy with five digits."""
    return ranked(lexicon).select(F.format_string("%s\t%.5f", F.array_join("ngram", separator), "autonomy").alias("value"))
