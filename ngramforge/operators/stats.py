"""Branching entropy, its variation and the autonomy score, from counts.

All tables hold both reading directions, told apart by back.  Undefined is NULL throughout; a NaN
would poison the means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ngramforge.functions.keys import MARKERS, first, last, prefix, suffix

#: Deviations below this count as 0: they are rounding errors of equal values.
LEAST_DEVIATION = 1e-12
MEASURES = ("entropy", "ev", "autonomy", "centred")


def entropies(counts: DataFrame, terminals: tuple[str, ...] = MARKERS) -> DataFrame:
    """(back, k, ngram, entropy) of every n-gram with children in a direction, the empty one included.

    With N the children's total: log2 N less 1/N times the sum of c log2 c over the children that
    are no terminal; a terminal counts as N different ones.  The sum is one mergeable aggregate, so
    parents with many children are combined before the shuffle; there is one pass over counts and
    one shuffle for both directions.  Exact zeros matter for the variation and are set, not
    computed.

    The keys are never NULL, and known not to be: the table then enters the join with its parents
    on both sides without a filter on either, so that its shuffle is used for both.
    """
    key = lambda c: F.coalesce(c, F.lit(""))
    ends = lambda edge: edge.isin(*terminals) if terminals else F.lit(False)
    sides = F.array(
        F.struct(F.lit(False).alias("back"), key(prefix("ngram", "k")).alias("ngram"), F.col("count").alias("c"), ends(last(F.col("ngram"))).alias("t")),
        F.struct(F.lit(True).alias("back"), key(suffix("ngram", "k")).alias("ngram"), F.col("back_count").alias("c"), ends(first(F.col("ngram"))).alias("t")),
    )
    rows = counts.where("k > 0").select(F.coalesce(F.col("k") - 1, F.lit(0)).alias("k"), F.explode(sides).alias("s")).select("k", "s.*").where("c > 0")
    rows = rows.withColumn("back", F.coalesce("back", F.lit(False))).withColumn("ngram", key(F.col("ngram")))
    summed = rows.groupBy("back", "k", "ngram").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("t"), 0.0).otherwise(F.col("c") * F.log2("c"))).alias("q"), F.count("*").alias("children"), F.max("t").alias("ends"))
    zero = (F.col("n") == 1) | ((F.col("children") == 1) & ~F.col("ends"))
    return summed.select("back", "k", "ngram", F.when(zero, 0.0).otherwise(F.log2("n") - F.col("q") / F.col("n")).alias("entropy"))


def direction(table: DataFrame, back: bool = False) -> DataFrame:
    """The rows of one reading direction."""
    return table.where(F.col("back") == back).drop("back")


def variations(entropies_: DataFrame) -> DataFrame:
    """(back, k, ngram, entropy, ev): entropy less the parent's, NULL where both are 0.

    The empty n-gram stays, without a variation; n-grams whose parent has no entropy go.
    """
    above = F.when(F.col("back"), suffix("ngram", "k")).otherwise(prefix("ngram", "k"))
    # The empty n-gram finds no parent of length -1.
    child = entropies_.select("back", "k", "ngram", "entropy", (F.col("k") - 1).alias("pk"), above.alias("pg"))
    parent = entropies_.select(F.col("back").alias("pb"), F.col("k").alias("k_"), F.col("ngram").alias("ngram_"), F.col("entropy").alias("h"))
    joined = child.join(parent, (F.col("back") == F.col("pb")) & (F.col("pk") == F.col("k_")) & (F.col("pg") == F.col("ngram_")), "left").where("k = 0 OR h IS NOT NULL")
    ev = F.when((F.col("entropy") != 0) | (F.col("h") != 0), F.col("entropy") - F.col("h"))
    return joined.select("back", "k", "ngram", "entropy", ev.alias("ev"))


def norms(variations_: DataFrame) -> DataFrame:
    """(back, k, mean, stdev) of the variation over the n-grams of each length that have one; a row for each length and direction, so it may be broadcast at any input size."""
    known = variations_.where("ev IS NOT NULL").groupBy("back", "k").agg(F.avg("ev").alias("mean"), F.stddev_pop("ev").alias("stdev"))
    return known.withColumn("stdev", F.when(F.col("stdev") < LEAST_DEVIATION, 0.0).otherwise(F.col("stdev")))


def pooled(varied: DataFrame, lone: DataFrame | None) -> DataFrame:
    """norms() of a corpus' windows; lone: what is added backwards for the n-grams of three tokens on that occur once and begin with no marker."""
    if lone is None:
        return norms(sides(varied))
    apart = (F.col("k") > 2) & (F.col("count") == 1) & ~first(F.col("ngram")).isin(*MARKERS)
    each = varied.select("k", "ev", F.when(~apart, F.col("back_ev")).alias("back_ev")).groupBy("k").agg(*(f(v).alias(f"{n}_{v}") for v in ("ev", "back_ev") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))))
    own = [each.select("k", F.lit(back).alias("back"), F.col(f"n_{v}").alias("n"), F.col(f"mean_{v}").alias("mean"), (F.col(f"var_{v}") * F.col(f"n_{v}")).alias("m2")) for back, v in ((False, "ev"), (True, "back_ev"))]
    pieces = own[0].unionByName(own[1]).unionByName(lone.withColumn("back", F.lit(True))).where("n > 0")
    of = Window.partitionBy("k", "back")
    # Squares are summed around the common mean, as differences of large sums would leave a deviation where there is none.
    centred = pieces.withColumn("mid", F.sum(F.col("n") * F.col("mean")).over(of) / F.sum("n").over(of))
    known = centred.groupBy("k", "back").agg(F.max("mid").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mid")) ** 2) / F.sum("n")).alias("stdev"))
    return known.withColumn("stdev", F.when(F.col("stdev") < LEAST_DEVIATION, 0.0).otherwise(F.col("stdev")))


def norm_vector(variations_: DataFrame, depth: int) -> DataFrame:
    """every_length() of norms()."""
    return every_length(norms(variations_), depth)


def every_length(norms_: DataFrame, depth: int) -> DataFrame:
    """norms() with a row for each length from 1 to depth and direction; mean and deviation are 0 where no variation is defined."""
    lengths = norms_.sparkSession.range(1, depth + 1).select(F.col("id").cast("int").alias("k"))
    every = lengths.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "k")
    return every.join(F.broadcast(norms_), ["back", "k"], "left").select("back", "k", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("stdev", F.lit(0.0)).alias("stdev"))


def scored(variations_: DataFrame) -> DataFrame:
    """variations with autonomy, (ev - mean) / stdev, and centred, ev - mean; NULL where ev is, autonomy also where stdev is 0."""
    off = F.col("ev") - F.col("mean")
    score = F.when(F.col("stdev") > 0, off / F.col("stdev"))
    return variations_.join(F.broadcast(norms(variations_)), ["back", "k"], "left").select("back", "k", "ngram", "entropy", "ev", score.alias("autonomy"), off.alias("centred"))


def sides(varied: DataFrame) -> DataFrame:
    """(back, k, ngram, entropy, ev) as of variations(), of a corpus' windows."""
    each = F.array(*(F.struct(F.lit(back).alias("back"), "k", "ngram", F.col(h).alias("entropy"), F.col(v).alias("ev")) for back, h, v in ((False, "h", "ev"), (True, "back_h", "back_ev"))))
    return varied.select(F.explode(each).alias("s")).select("s.*").where("entropy IS NOT NULL")


def measured(varied: DataFrame, lone: DataFrame | None = None) -> DataFrame:
    """averaged(), of a corpus' windows: both directions stand in one row already. lone: as for pooled()."""
    if lone is None:
        columns = [(F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"dev_{v}")) for v in ("ev", "back_ev")]
        known = varied.groupBy(F.col("k").alias("_k")).agg(*columns[0], *columns[1])
    else:
        one = lambda m, back: F.max(F.when(F.col("back") == back, F.col(m)))
        known = pooled(varied, lone).groupBy(F.col("k").alias("_k")).agg(*(one(m, back).alias(f"{name}_{v}") for back, v in ((False, "ev"), (True, "back_ev")) for m, name in (("mean", "mean"), ("stdev", "dev"))))
    rows = varied.where("h IS NOT NULL AND back_h IS NOT NULL").join(F.broadcast(known), F.col("k") == F.col("_k"), "left")
    off = {v: F.col(v) - F.col(f"mean_{v}") for v in ("ev", "back_ev")}
    score = [F.when(F.col(f"dev_{v}") >= LEAST_DEVIATION, off[v] / F.col(f"dev_{v}")) for v in off]
    mean = lambda a, b, name: ((a + b) / 2).alias(name)
    return rows.select("k", "ngram", "count", mean(F.col("h"), F.col("back_h"), "entropy"), mean(F.col("ev"), F.col("back_ev"), "ev"), mean(*score, "autonomy"), mean(*off.values(), "centred"))


def averaged(counts: DataFrame) -> DataFrame:
    """(k, ngram, count, MEASURES): each measure as the mean of both directions, NULL where either is.

    n-grams without children in either are absent; the empty one is there, with its entropy alone.
    The counts read forwards come along in the same shuffle.
    """
    sides = scored(variations(entropies(counts)))
    side = lambda m, back: F.max(F.when(F.col("back") == back, F.col(m)))
    means: list[Column] = [((side(m, False) + side(m, True)) / 2).alias(m) for m in MEASURES]
    own = counts.select(F.lit(None).cast("boolean").alias("back"), "k", "ngram", *(F.lit(None).cast("double").alias(m) for m in MEASURES), "count")
    rows = sides.withColumn("count", F.lit(None).cast("long")).unionByName(own)
    return rows.groupBy("k", "ngram").agg(F.count("back").alias("sides"), F.max("count").alias("count"), *means).where("sides = 2").select("k", "ngram", "count", *MEASURES)
