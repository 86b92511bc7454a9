"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ngramforge.llm import language, minhash, packing, suffixes
from ngramforge.sources.folders import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, with the language found in lang.

    Null and empty texts, ones of hardly any letter and ones strange to all languages that are
    labelled go; without labelled rows all others stay.  Each row is judged by itself, so repeated
    rows go or stay together; a null doc_id or lang does not matter; all columns stay, whatever
    their names; an empty table stays empty.
    """
    return language.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one of least doc_id, a null one last.

    Of rows equal in doc_id and text the one whose other columns hash least stays.  Null texts and
    ones without near copies stay; empty texts are copies of each other.  Texts of any length are
    compared whole; all columns stay, whatever their names; an empty table stays empty.
    """
    return minhash.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier, in text and n_chars; emptied ones go.

    Earlier is by doc_id, null ones last, then by the text's key, then by the place in the text.
    Null, empty and short texts stay as they are; rows equal in doc_id and text are one document and
    are cut alike; all other columns stay, whatever their names; an empty table stays empty.
    """
    return suffixes.keep(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of fixed length over the documents in the order of doc_id, null ones last, then of the text's key.

    Only doc_id and text go on, in doc_ids and texts; all further columns are left out.  Null and
    blank texts are in no window; rows that repeat are packed each; a text of any length is packed
    whole; an empty table gives no windows.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed_windows),
]

#: Alignment, support vector machines and the packing program have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.

    What each stage but the last returns is written as Parquet to the shared folder and read from
    there: the next stage scans it several times, and nothing is computed anew for that.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
