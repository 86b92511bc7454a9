"""Segmentation of raw text: sentences split at blanks, or runs of one Unicode category, of which those of CJK characters are segmented."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ngramforge.functions import tags, tokens
from ngramforge.functions.names import column, content, unused
from ngramforge.operators.segment import segment

#: How the tokens of a segmented sentence may be tagged.
STYLES = {"bies": tags.format_bies, "token_in_word": tags.format_token_in_word, "token_in_word_bies": tags.format_token_in_word_bies}


def tag_sentences(lines: DataFrame, scores: DataFrame, order: int, style: str = "bies") -> DataFrame:
    """lines (text) with tagged: sentences split at single blanks, segmented, and their tokens tagged; a null text gives null.  All other columns stay."""
    kept = [c for c in lines.columns if c != "tagged"]
    (whole,) = unused(lines, "_row")
    rows = lines.select(F.struct(*map(column, kept)).alias(whole), tokens.space_tokens(F.col("text")).alias("tokens"))
    return segment(rows, scores, order).select(*(F.col(whole)[c].alias(c) for c in kept), STYLES[style](F.col("words")).alias("tagged"))


def segment_text(lines: DataFrame, scores: DataFrame, order: int, bies: bool = True) -> DataFrame:
    """lines (text) with segmented: words or tagged characters joined by a blank.

    White space between words is a run like others and is kept.  Each distinct text is cut once;
    all its runs meet again in their order.  A text without runs gives an empty string, a null one
    null.  All other columns stay.
    """
    kept = [c for c in lines.columns if c != "segmented"]
    key, other, out = unused(lines, "_key", "_other", "_out")
    keyed = lines.withColumn(key, content(F.col("text")))
    texts = keyed.where(f"{key} IS NOT NULL").groupBy(F.col(key).alias("key")).agg(F.first("text").alias("text"))
    runs = texts.select("key", F.posexplode(tokens.category_runs(F.col("text"))).alias("run", "piece"))
    cjk = runs.where(tokens.is_cjk(F.col("piece"))).withColumn("tokens", tokens.characters(F.col("piece")))
    cut = segment(cjk, scores, order).select("key", "run", F.transform("words", lambda w: F.array_join(w, "")).alias("pieces"))
    rest = runs.where(~tokens.is_cjk(F.col("piece"))).select("key", "run", F.array("piece").alias("pieces"))
    tagged = F.flatten(F.transform("pieces", tags.character_bies)) if bies else F.col("pieces")
    both = cut.unionByName(rest).select("key", F.struct("run", tagged.alias("out")).alias("part"))
    joined = both.groupBy(F.col("key").alias(other)).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["out"])), " ").alias(out))
    found = keyed.join(joined, F.col(key) == F.col(other), "left")
    return found.select(*map(column, kept), F.when(F.col("text").isNotNull(), F.coalesce(out, F.lit(""))).alias("segmented"))
