"""Command line: lexicons, models and segmented text from files of lines.

    python -m ngramforge.cli lexicon CORPUS TARGET --order 3 --sep " "
    python -m ngramforge.cli train CORPUS --model MODEL [--vocabulary [--sep " "]]
    python -m ngramforge.cli segment CORPUS --target TARGET [--model MODEL] [--bies]
    python -m ngramforge.cli nbest CORPUS --target TARGET [--nbest 5]

CORPUS is - for standard input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ngramforge.functions import tokens
from ngramforge.operators import lexicon, preprocess
from ngramforge.operators.segment import check_order, segment_nbest
from ngramforge.plans.model import NgramModel
from ngramforge.sources import corpora, models
from ngramforge.sources.folders import shared_folder
from ngramforge.streaming import training

#: Lines after which counts are pruned, where they are.
BATCH = 100_000
#: Longest word of a trained model's lexicon.
LONGEST = 5


def build_lexicon(spark: SparkSession, corpus: str, target: str, order: int, separator: str = " ") -> None:
    """Writes the words of up to order tokens with their autonomy, the best first."""
    lines = corpora.sentences_of(corpora.lines(spark, corpus)).where(F.size("tokens") > 0)
    found = NgramModel.fit(lines, order + 1).lexicon(lexicon.candidates(lines, order))
    models.write_lines(lexicon.formatted(found, separator), target)


def train(lines: DataFrame, length: int, prune: int = 0, size: int = 0) -> tuple[NgramModel, DataFrame]:
    """Model of the runs of CJK characters of lines (value, and line where they are numbered), and those runs; size takes the first lines, 0 takes all.

    With prune, counts lose that much after each BATCH lines; a last batch that is not full is not
    pruned.  Lines are then written by batch to the shared folder, and each batch is read once and
    added to the table of counts of the batches before.
    """
    spark = lines.sparkSession
    lines = corpora.numbered(lines).where(F.col("line") < size).select("line", "value") if size else lines
    if not prune:
        chunks = corpora.chunks_of(lines)
        return NgramModel.fit(chunks, length), chunks
    folder = shared_folder(spark, "train")
    corpora.numbered(lines).withColumn("batch", F.expr(f"line div {BATCH}")).write.partitionBy("batch").parquet(f"{folder}/lines")
    held = spark.read.parquet(f"{folder}/lines")
    total = held.count()
    for batch in range(-(-total // BATCH)):
        full = (batch + 1) * BATCH <= total
        training.add_batch(corpora.chunks_of(held.where(F.col("batch") == batch)), batch, f"{folder}/model", length, prune if full else 0)
    return training.latest(spark, f"{folder}/model", length), corpora.chunks_of(held)


def segment_lines(lines: DataFrame, scores: DataFrame, order: int, bies: bool = False) -> DataFrame:
    """(line, value): each line that is not blank, segmented."""
    rows = corpora.numbered(lines).select(F.col("value").alias("text"), "line").where(~tokens.is_blank(F.col("value")))
    return preprocess.segment_text(rows, scores, order, bies).select("line", F.col("segmented").alias("value"))


def nbest_of(lines: DataFrame, length: int, several: int) -> DataFrame:
    """(line, rank, value): the best segmentations of each line into characters, by the model of all lines."""
    rows = corpora.numbered(lines).select(F.regexp_replace(tokens.strip(F.col("value")), " ", "").alias("text"), "line")
    rows = rows.select("line", tokens.characters(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    found = segment_nbest(rows, NgramModel.fit(rows, length).scores, check_order(None, length), several)
    return models.nbest_lines(found, "line")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ngramforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    actions = parser.add_subparsers(dest="action", required=True)
    for name in ("lexicon", "train", "segment", "nbest"):
        one = actions.add_parser(name)
        one.add_argument("corpus", help="text file or folder of lines, - for standard input")
        if name == "lexicon":
            one.add_argument("target", help="folder of the lexicon")
            one.add_argument("-o", "--order", type=int, required=True, help="longest word in tokens")
            one.add_argument("-s", "--sep", default=" ", help="what stands between the tokens of a word")
            continue
        one.add_argument("-l", "--ngram-length", type=int, default=5)
        one.add_argument("-t", "--target", required=name != "train", help="folder of the segmented lines")
        if name == "nbest":
            one.add_argument("-n", "--nbest", type=int, default=5)
            continue
        one.add_argument("-m", "--model", required=name == "train", help="folder of the model as tab-separated text")
        one.add_argument("-L", "--lines", type=int, default=100_000, help="lines to train on, 0 for all")
        one.add_argument("-p", "--prune", type=int, default=0, help=f"what counts lose after each {BATCH} lines")
        if name == "train":
            one.add_argument("--vocabulary", action="store_true", help="write all n-grams of the model that have an autonomy, not only the words of the corpus")
            one.add_argument("-s", "--sep", default="", help="what stands between the tokens of an n-gram")
        if name == "segment":
            one.add_argument("--bies", action="store_true", help="tag characters instead of writing blanks between words")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("ngramforge").getOrCreate()
    if given.corpus == "-":
        given.corpus = corpora.piped(spark, sys.stdin, shared_folder(spark, "stdin"))
    if given.action == "lexicon":
        build_lexicon(spark, given.corpus, given.target, given.order, given.sep)
        return
    lines = corpora.numbered_lines(spark, given.corpus)
    if given.action == "nbest":
        models.write_lines(nbest_of(lines, given.ngram_length, given.nbest).orderBy("line", "rank"), given.target)
        return
    if given.action == "train" or not given.model:
        model, chunks = train(lines, given.ngram_length, given.prune, given.lines)
        if given.action == "train":
            found = model.lexicon() if given.vocabulary else model.lexicon(lexicon.candidates(chunks, LONGEST))
            models.write_tsv(found, given.model, given.sep)
            return
        scores, length = model.scores, model.default_ngram_length
    else:
        read = models.read_tsv(spark, given.model)
        scores, length = read.scores, read.default_ngram_length
    models.write_lines(segment_lines(lines, scores, check_order(None, length), given.bies).orderBy("line"), given.target)


if __name__ == "__main__":
    main()
