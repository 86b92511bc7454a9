"""Column names and keys that don't meet those of the user's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Those names, lengthened until no column of rows is called like them in either case."""
    held = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def content(value: Column) -> Column:
    """128-bit key of a string or an array of strings, null for null; null elements count."""
    return F.when(value.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value, F.lit(1)).alias("b")))
