"""Scored models as tab-separated text or Parquet, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.functions import keys
from ngramforge.functions.tokens import characters, strip


class ScoredModel:
    """(k, ngram, autonomy, count) without the statistics behind: enough to segment by."""

    def __init__(self, scores: DataFrame):
        self.scores = scores

    @property
    def default_ngram_length(self) -> int:
        """One more than the longest n-gram."""
        return (self.scores.agg(F.max("k")).first()[0] or 0) + 1

    def query(self, ngrams: DataFrame) -> DataFrame:
        """ngrams (ngram array<string>) with autonomy and count; NULL and 0 where not known."""
        asked = ngrams.withColumn("_k", F.size("ngram")).withColumn("_g", keys.key(F.col("ngram")))
        known = self.scores.select(F.col("k").alias("_k"), F.col("ngram").alias("_g"), "autonomy", "count")
        return asked.join(known, ["_k", "_g"], "left").withColumn("count", F.coalesce("count", F.lit(0))).drop("_k", "_g")

    def query_autonomy(self, ngram: list[str]) -> float | None:
        row = self.scores.where((F.col("k") == len(ngram)) & (F.col("ngram") == keys.literal(ngram))).first()
        return row.autonomy if row else None

    def query_count(self, ngram: list[str]) -> int:
        row = self.scores.where((F.col("k") == len(ngram)) & (F.col("ngram") == keys.literal(ngram))).first()
        return row["count"] if row else 0


def parse_tsv(lines: DataFrame, delimiter: str = "") -> DataFrame:
    """(k, ngram, autonomy, count) of lines (value) of n-gram, autonomy and count between tabs.

    Without a delimiter each character is a token.  Of lines that repeat an n-gram the last one
    read counts.
    """
    fields = F.split(strip(F.col("value")), "\t")
    tokens = characters(fields[0]) if not delimiter else F.split(fields[0], "\\Q" + delimiter + "\\E", -1)
    rows = lines.withColumn("_at", F.monotonically_increasing_id()).where(F.col("value").contains("\t"))
    rows = rows.select(tokens.alias("t"), fields[1].cast("double").alias("autonomy"), fields[2].cast("long").alias("count"), "_at")
    rows = rows.select(F.size("t").alias("k"), keys.key(F.col("t")).alias("ngram"), "autonomy", "count", "_at")
    latest = Window.partitionBy("k", "ngram").orderBy(F.desc("_at"))
    return rows.withColumn("i", F.row_number().over(latest)).where("i = 1").select("k", "ngram", "autonomy", "count")


def format_tsv(lexicon: DataFrame, delimiter: str = "") -> DataFrame:
    """(value) of a lexicon (ngram array<string>, autonomy, count); n-grams without autonomy are left out."""
    return lexicon.where("autonomy IS NOT NULL").select(F.concat_ws("\t", F.array_join("ngram", delimiter), F.col("autonomy").cast("string"), F.col("count").cast("string")).alias("value"))


def read_tsv(spark: SparkSession, path: str, delimiter: str = "") -> ScoredModel:
    return ScoredModel(parse_tsv(spark.read.text(path), delimiter))


def write_tsv(lexicon: DataFrame, path: str, delimiter: str = "") -> None:
    format_tsv(lexicon, delimiter).write.mode("overwrite").text(path)


def read_parquet(spark: SparkSession, path: str) -> ScoredModel:
    lexicon = spark.read.parquet(path)
    return ScoredModel(lexicon.select(F.size("ngram").alias("k"), keys.key(F.col("ngram")).alias("ngram"), "autonomy", "count"))


def write_parquet(lexicon: DataFrame, path: str) -> None:
    """The columnar form of a scored lexicon, n-grams as arrays."""
    lexicon.where("autonomy IS NOT NULL").write.mode("overwrite").parquet(path)


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """One line of text for each row."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def nbest_lines(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, rank, value): one row for each segmentation of nbest, words joined by two blanks, the tokens of a word without anything between."""
    each = rows.select(*ids, F.posexplode("nbest").alias("rank", "s"))
    return each.select(*ids, "rank", F.array_join(F.transform("s.words", lambda w: F.array_join(w, "")), "  ").alias("value"))


def merge_counts(stored: DataFrame, more: DataFrame, key: list[str], value: str = "count") -> DataFrame:
    """Upsert of counts: rows of either table, values of equal keys added."""
    return stored.unionByName(more).groupBy(*key).agg(F.sum(value).alias(value))
