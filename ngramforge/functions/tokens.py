"""Tokenizers, Unicode classes and predicates of text, as JVM expressions wherever Spark has one."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Runs of one general category; cased letters of either case are one class, unassigned characters the last.
CATEGORIES = ("Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co")
CATEGORY_RUN = "[\\p{Lu}\\p{Ll}]+" + "".join(f"|\\p{{{c}}}+" for c in CATEGORIES)
CATEGORY_RUN_JAVA = CATEGORY_RUN + "|[\\p{Cn}\\p{Cs}]+"

#: Code points whose Unicode name starts with CJK.
CJK = ((0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x31C0, 0x31E3), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x20000, 0x2A6DF), (0x2A700, 0x2B739), (0x2B740, 0x2B81D), (0x2B820, 0x2CEA1), (0x2CEB0, 0x2EBE0), (0x2EBF0, 0x2EE5D), (0x2F800, 0x2FA1D), (0x30000, 0x3134A), (0x31350, 0x323AF))
CJK_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK)

_SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def category_runs(text: Column) -> Column:
    """Maximal runs of characters of one Unicode category; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(CATEGORY_RUN_JAVA), F.lit(0))


def category(character: Column) -> Column:
    """General category of the first character, "latin" for cased letters; null for an empty string."""
    out = F.when(character.rlike("^[\\p{Lu}\\p{Ll}]"), F.lit("latin"))
    for c in CATEGORIES:
        out = out.when(character.rlike(f"^\\p{{{c}}}"), F.lit(c))
    return out.when(F.length(character) > 0, F.lit("Cn"))


def is_cjk(token: Column) -> Column:
    """Whether the first character has a name that starts with CJK; false for an empty string."""
    return token.rlike(f"^[{CJK_CLASS}]")


def filter_cjk(tokens: Column) -> Column:
    return F.filter(tokens, is_cjk)


def cjk_chunks(text: Column) -> Column:
    """The runs of a text that start with a CJK character."""
    return filter_cjk(category_runs(text))


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no expression for it."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def whitespace_tokens(text: Column) -> Column:
    """Words between any white space, that of Unicode included."""
    return F.filter(F.split(text, _SPACE + "+"), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Parts between single blanks; empty parts stay."""
    return F.split(text, " ", -1)


def characters(text: Column) -> Column:
    """Code points."""
    return F.filter(F.split(text, ""), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE[1:-1]}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def sentences(text: Column) -> Column:
    """Non-empty lines and full-stop-separated parts of a text."""
    return F.filter(F.split(text, "[.\\n]"), lambda t: t != "")


def spans(tokens: Column, longest: int) -> Column:
    """All contiguous slices of up to that many tokens."""
    size = F.size(tokens)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.slice(tokens, i, k))
    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(1), size), at))).otherwise(F.array().cast("array<array<string>>"))

