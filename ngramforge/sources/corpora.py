"""Corpora as sentences of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ngramforge.functions import tokens


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.

    One of fewer splits than the session has cores, as of few row groups, is dealt out to all cores
    first, by a shuffle of the columns that are read; a larger one is read as it is.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _numbered(rows: DataFrame, *block: str) -> DataFrame:
    """rows (block, value) as (line, value): the lines of each block follow each other in a task, blocks stand in the order of those columns.

    Only the blocks' sizes are put in one order, a row for each split; lines are not moved.
    """
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    if not block:
        rows, block = rows.withColumn("_block", F.shiftright("_at", 33)), ("_block",)
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*block, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, list(block)).select((F.col("base") + F.col("_at") - F.col("first")).alias("line"), "value")


def numbered(texts: DataFrame) -> DataFrame:
    """(line, value) of texts (value), numbered from 0 in the order in which they are read."""
    return texts.select("line", "value") if "line" in texts.columns else _numbered(texts.select("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of each line of UTF-8 text, numbered from 0 in the order of files' names and places."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return _numbered(rows, "_file", "_start")


def lines(spark: SparkSession, path: str, size: int = 0) -> DataFrame:
    """(value) of each line of UTF-8 text; size takes exactly that many of the first lines, 0 takes all."""
    return numbered_lines(spark, path).where(F.col("line") < size).select("value") if size else spark.read.text(path)


def piped(spark: SparkSession, stream: Iterable[str], folder: str, size: int = 100_000) -> str:
    """The folder, with the lines of a stream that only the driver can read, some at a time."""
    rest = iter(stream)
    for number in count():
        part = [(x.rstrip("\n"),) for x in islice(rest, size)]
        if not part and number:
            return folder
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/part={number:08d}")
    return folder


def sentences_of(texts: DataFrame, tokenize: Callable[[Column], Column] = tokens.whitespace_tokens, column: str = "value") -> DataFrame:
    """(tokens) of each text."""
    return texts.select(tokenize(F.col(column)).alias("tokens"))


def chunks_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """(tokens) of each run of CJK characters: its characters."""
    return texts.select(F.explode(tokens.cjk_chunks(F.col(column))).alias("chunk")).select(tokens.characters(F.col("chunk")).alias("tokens"))


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line, tokens): the words of each line of documents, in lower case; lines without words are left out."""
    each = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return each.select("doc_id", "line", tokens.word_tokens(F.lower("value")).alias("tokens")).where(F.size("tokens") > 0)


def event_sequences(events: DataFrame) -> DataFrame:
    """(user_id, tokens): the event types of each user in order of time, then id."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy("user_id").agg(F.transform(ordered, lambda e: e["event_type"]).alias("tokens"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, tokens): the roles of each conversation in order of the turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return conversations.groupBy("conv_id").agg(F.transform(ordered, lambda e: e["role"]).alias("tokens"))


def xml_sentences(spark: SparkSession, path: str, row_tag: str = "page", text: str = "revision.text") -> DataFrame:
    """(tokens) of each full-stop-separated part of the texts of an XML dump, which may be compressed: words of up to 30 letters, digits and hyphens in lower case."""
    pages = spark.read.format("xml").option("rowTag", row_tag).load(path)
    of = F.col(text)
    if dict(pages.select(of.alias("t")).dtypes)["t"].startswith("struct"):
        of = F.col(f"{text}._VALUE")
    parts = pages.select(F.explode(F.split(F.lower(of), "\\.")).alias("s"))
    return parts.select(F.regexp_extract_all("s", F.lit("[\\p{L}\\p{N}_-]{1,30}"), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
