"""Tags of tokens by their place in the words of a segmentation (array<array<string>>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ngramforge.functions.tokens import characters


def _letter(i: Column, n: Column) -> Column:
    return F.when(n == 1, "S").when(i == 0, "B").when(i == n - 1, "E").otherwise("I")


def token_in_word(word: Column) -> Column:
    """token-BEFORE_AFTER for each token of a word, with the tokens before and after it in the word."""
    around = lambda t, i: F.concat(t, F.lit("-"), F.array_join(F.slice(word, F.lit(1), i), ""), F.lit("_"), F.array_join(F.slice(word, i + 2, F.size(word)), ""))
    return F.transform(word, around)


def bies(word: Column) -> Column:
    """token-S for a word of one token, else token-B, token-I and token-E."""
    return F.transform(word, lambda t, i: F.concat(t, F.lit("-"), _letter(i, F.size(word))))


def token_in_word_bies(word: Column) -> Column:
    """token_in_word() with the letter of bies() behind."""
    return F.zip_with(token_in_word(word), F.transform(word, lambda t, i: _letter(i, F.size(word))), lambda a, b: F.concat(a, F.lit("-"), b))


def format_token_in_word(words: Column) -> Column:
    return F.array_join(F.flatten(F.transform(words, token_in_word)), " ")


def format_bies(words: Column) -> Column:
    return F.array_join(F.flatten(F.transform(words, bies)), " ")


def format_token_in_word_bies(words: Column) -> Column:
    return F.array_join(F.flatten(F.transform(words, token_in_word_bies)), " ")


def character_bies(word: Column) -> Column:
    """bies() over the characters of a string; the empty string has none."""
    return bies(characters(word))
