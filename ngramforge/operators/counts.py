"""N-gram counts.

One table serves both reading directions: runs of two tokens and more occur as often read from
either side, and only single tokens at the borders differ.  Schema of counts: (k, ngram, count,
back_count), with k the number of tokens, ngram their key (ngramforge.functions.keys), count the
occurrences read forwards and back_count those read backwards.  The empty n-gram counts windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ngramforge.functions.keys import END, ESC, MARKERS, SEP, START, escape, first, last, prefix
from ngramforge.operators import windows as W

COUNTS = ("k", "ngram", "count", "back_count")


def checked(freq: Column) -> Column:
    """freq, failing on values below 1."""
    return F.when(freq >= 1, freq).otherwise(F.raise_error(F.lit("larger or equal to 1 is what a frequency must be")).cast("long"))


def padded(sentences: DataFrame, length: int) -> DataFrame:
    """(tokens, freq, n): escaped tokens between the markers; empty sentences and null tokens are left out.

    sentences has tokens array<string> and, where they differ, freq and ngram_length.
    """
    if length < 1:
        raise ValueError("n-grams have one token at least")
    freq = checked(F.coalesce(F.col("freq").cast("long"), F.lit(1))) if "freq" in sentences.columns else F.lit(1).cast("long")
    n = F.coalesce(F.col("ngram_length"), F.lit(length)) if "ngram_length" in sentences.columns else F.lit(length)
    inner = escaped(F.col("tokens"))
    tokens = F.concat(F.array(F.lit(START)), inner, F.array(F.lit(END)))
    return sentences.select(tokens.alias("tokens"), freq.alias("freq"), n.cast("int").alias("n")).where(F.size("tokens") > 2)


def escaped(tokens: Column) -> Column:
    """The tokens that are not null, escaped.

    Lambdas run token by token outside of generated code, so a look at the joined tokens tells
    first whether any is null or holds what is to be escaped; hardly any sentence does.
    """
    joined = F.array_join(tokens, SEP, ESC)
    plain = (F.instr(joined, ESC) == 0) & (F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(SEP), F.lit(""))) == F.size(tokens) - 1)
    return F.when(plain, tokens).otherwise(F.transform(F.filter(tokens, lambda t: t.isNotNull()), escape))


def shifted(rows: DataFrame, tokens: str, longest: int, *kept: str) -> DataFrame:
    """(kept, at, t1, t2, ...): each token with those that follow it, NULL beyond the end.

    The arrays are zipped before they are exploded: no row carries its whole sentence along.
    """
    names = [f"t{j}" for j in range(1, longest + 1)]
    ahead = [(F.slice(tokens, j + 1, F.size(tokens)) if j else F.col(tokens)).alias(name) for j, name in enumerate(names)]
    zipped = rows.select(*kept, *ahead).select(*kept, F.posexplode(F.arrays_zip(*names)).alias("at", "t"))
    # A slice beyond the end is empty, so the zipped array is as long as the sentence.
    return zipped.select(*kept, "at", "t.*")


def windows(rows: DataFrame, longest: int) -> DataFrame:
    """(k, ngram, forwards, backwards): every run of up to n tokens, with the frequency that each direction gives it.

    The last token starts no window read forwards and the first none read backwards, so each is no
    single token in that direction.  Keys are built by generated code, not by lambdas.
    """
    at = shifted(rows, "tokens", max(2, longest), "freq", "n")
    one = F.struct(F.lit(1).alias("k"), F.col("t1").alias("ngram"), F.when(F.col("t2").isNotNull(), F.col("freq")).otherwise(0).alias("forwards"), F.when(F.col("at") > 0, F.col("freq")).otherwise(0).alias("backwards"))
    more = [
        F.when((F.col("n") >= k) & F.col(f"t{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.concat_ws(SEP, *(f"t{j}" for j in range(1, k + 1))).alias("ngram"), F.col("freq").alias("forwards"), F.col("freq").alias("backwards")))
        for k in range(2, longest + 1)
    ]
    return at.select(F.explode(F.array(one, *more)).alias("w")).where("w IS NOT NULL").select("w.k", "w.ngram", "w.forwards", "w.backwards")


def roots(rows: DataFrame) -> DataFrame:
    """windows() of the empty n-gram, one for each sentence: it stands before all tokens but the last."""
    each = F.col("freq") * (F.size("tokens") - 1)
    return rows.select(F.lit(0).alias("k"), F.lit("").alias("ngram"), each.alias("forwards"), each.alias("backwards"))


def summed(windows_: DataFrame) -> DataFrame:
    return windows_.groupBy("k", "ngram").agg(F.sum("forwards").alias("count"), F.sum("backwards").alias("back_count"))


def count(sentences: DataFrame, length: int, longest: int | None = None) -> DataFrame:
    """Counts of all n-grams of sentences; longest bounds ngram_length where that is above length."""
    return W.count(padded(sentences, length), longest or length)


def count_ngrams(ngrams: DataFrame) -> DataFrame:
    """Counts of a bare store of (ngram array<string>, freq): each adds to all its prefixes, with no markers around; empty ones are left out.

    back_count is null: the direction is the caller's, who may reverse the n-grams.
    """
    freq = checked(F.coalesce(F.col("freq").cast("long"), F.lit(1))) if "freq" in ngrams.columns else F.lit(1).cast("long")
    rows = ngrams.where(F.size("ngram") > 0).select(F.transform("ngram", escape).alias("t"), freq.alias("freq"))
    each = rows.select("t", "freq", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("k"))
    grams = each.select("k", F.array_join(F.slice("t", F.lit(1), F.col("k")), SEP).alias("ngram"), "freq")
    return grams.groupBy("k", "ngram").agg(F.sum("freq").alias("count")).withColumn("back_count", F.lit(None).cast("long"))


def merge(*counts: DataFrame) -> DataFrame:
    """Counts of several corpora together."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy("k", "ngram").agg(F.sum("count").alias("count"), F.sum("back_count").alias("back_count"))


def prune(counts: DataFrame, q: int = 1) -> DataFrame:
    """Every count less q; n-grams that fall to 0 go, and all longer ones with them as they count no more.  The number of windows stays."""
    less = lambda c: F.when(F.col("k") == 0, F.col(c)).otherwise(F.greatest(F.col(c) - q, F.lit(0)))
    out = counts.withColumn("count", less("count")).withColumn("back_count", less("back_count"))
    return out.where((F.col("k") == 0) | (F.col("count") > 0) | (F.col("back_count") > 0))


def leaves(counts: DataFrame) -> DataFrame:
    """N-grams read forwards that no longer one continues."""
    parents = counts.where("k > 0 AND count > 0").select((F.col("k") - 1).alias("k"), prefix("ngram", "k").alias("ngram")).distinct()
    return counts.where("k > 0 AND count > 0").join(parents, ["k", "ngram"], "left_anti")


def prune_leaves(counts: DataFrame, q: int = 1) -> DataFrame:
    """The leaf-wise variant, read forwards: each leaf loses q or what it has, each shorter n-gram what its leaves lost."""
    lost = leaves(counts).select("k", "ngram", F.least(F.col("count"), F.lit(q)).alias("lost"))
    each = lost.select("lost", "ngram", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k"))
    at = each.selectExpr("k", f"CASE WHEN k > 0 THEN substring_index(ngram, '{SEP}', k) ELSE '' END AS ngram", "lost")
    total = at.groupBy("k", "ngram").agg(F.sum("lost").alias("lost"))
    out = counts.where("k = 0 OR count > 0").join(total, ["k", "ngram"], "left").select("k", "ngram", (F.col("count") - F.coalesce("lost", F.lit(0))).alias("count"))
    return out.where("k = 0 OR count > 0")


def prune_hapax(counts: DataFrame) -> DataFrame:
    """Read forwards: n-grams that occur once go, and each shorter n-gram loses the occurrences that go below it."""
    once = counts.where("k > 0 AND count = 1").select("k", "ngram")
    above = once.withColumn("pk", F.col("k") - 1).withColumn("pg", prefix("ngram", "k"))
    tops = above.join(once.select(F.col("k").alias("pk"), F.col("ngram").alias("pg")), ["pk", "pg"], "left_anti")
    each = tops.select("ngram", F.explode(F.sequence(F.lit(0), F.col("pk"))).alias("k"))
    at = each.selectExpr("k", f"CASE WHEN k > 0 THEN substring_index(ngram, '{SEP}', k) ELSE '' END AS ngram")
    lost = at.groupBy("k", "ngram").agg(F.count("*").alias("lost"))
    out = counts.where("k = 0 OR count > 1").join(lost, ["k", "ngram"], "left").select("k", "ngram", (F.col("count") - F.coalesce("lost", F.lit(0))).alias("count"))
    return out.where("k = 0 OR count > 0")


def vocabulary(counts: DataFrame, markers: bool = True) -> DataFrame:
    """(k, ngram, count): n-grams read forwards, of any length from 1; those that hold a marker may be left out."""
    out = counts.where("k >= 1 AND count > 0").select("k", "ngram", "count")
    if not markers:
        out = out.where(unmarked("ngram"))
    return out


def unmarked(ngram: str) -> Column:
    """Whether neither end of an n-gram is a marker."""
    return ~(first(F.col(ngram)).isin(*MARKERS) | last(F.col(ngram)).isin(*MARKERS))


def max_depth(counts: DataFrame) -> DataFrame:
    """(depth): the longest n-gram; 0 where there is none."""
    return counts.where("count > 0 OR back_count > 0").agg(F.coalesce(F.max("k"), F.lit(0)).alias("depth"))
