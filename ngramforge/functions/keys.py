"""N-grams as one string: tokens joined by a separator that is escaped inside of tokens.

A string key shuffles, sorts and compares much faster than an array, and the parent of a key is a
prefix or suffix of it.  The number of tokens is kept beside the key, so that the empty n-gram and
an empty token differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

START = "\ue02b"
END = "\ue02d"
MARKERS = (START, END)
SEP = "\x1f"
ESC = "\x1e"
#: Stands for a null token where keys are compared; no token is escaped to it.
NULL = ESC + "2"


def escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit(ESC), F.lit(ESC + "0")), F.lit(SEP), F.lit(ESC + "1"))


def unescape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit(ESC + "1"), F.lit(SEP)), F.lit(ESC + "0"), F.lit(ESC))


def key(tokens: Column) -> Column:
    """Key of an array of tokens."""
    return F.array_join(F.transform(tokens, escape), SEP)


def literal(tokens: Sequence[str]) -> str:
    """Key of tokens known to the driver."""
    return SEP.join(t.replace(ESC, ESC + "0").replace(SEP, ESC + "1") for t in tokens)


def tokens(key_: Column, k: Column) -> Column:
    """Array of tokens of a key of k tokens."""
    return F.when(k > 0, F.transform(F.split(key_, SEP), unescape)).otherwise(F.array().cast("array<string>"))


def prefix(key_: Column | str, k: Column | str) -> Column:
    """Key of all tokens but the last."""
    key_, k = (F.col(c) if isinstance(c, str) else c for c in (key_, k))
    return F.when(k > 1, F.substr(key_, F.lit(1), F.length(key_) - F.length(last(key_)) - 1)).otherwise(F.lit(""))


def suffix(key_: Column | str, k: Column | str) -> Column:
    """Key of all tokens but the first."""
    key_, k = (F.col(c) if isinstance(c, str) else c for c in (key_, k))
    return F.when(k > 1, F.substr(key_, F.length(first(key_)) + 2)).otherwise(F.lit(""))


def first(key_: Column) -> Column:
    return F.substring_index(key_, SEP, 1)


def last(key_: Column) -> Column:
    return F.substring_index(key_, SEP, -1)
