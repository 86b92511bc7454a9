"""Queries of the engine's operators over the driver's tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ngramforge.functions import keys, tags, tokens
from ngramforge.operators import counts as C
from ngramforge.operators import lexicon, preprocess
from ngramforge.operators import segment as G
from ngramforge.operators import stats as S
from ngramforge.plans.model import DEFAULT_LENGTH, NgramModel
from ngramforge.sources import corpora, models
from ngramforge.sources.folders import shared_folder
from ngramforge.streaming import training

Query = Callable[[SparkSession, str], DataFrame]

#: Length of the n-grams of the queries' models, and the longest word that follows from it.
LENGTH = 3
ORDER = LENGTH - 1
#: The default length, for the queries with "long" in their names.
LONG = DEFAULT_LENGTH
#: Segmentations of each sentence.
NBEST = 3
#: Letters that stand for Chinese characters where raw text is wanted.
CJK_FROM, CJK_TO = "aeinorst", "我爱北京很大好他"
#: Rows of the ranked lexicon, which is a report of the best.
TOP = 100
DIGITS = 6

QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpora.table(spark, f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.lines_of(_table(spark, sf_dir, "documents"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.lines_of(_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


def _model(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> NgramModel:
    return NgramModel.fit(_lines(spark, sf_dir), length)


def _events(spark: SparkSession, sf_dir: str) -> NgramModel:
    return NgramModel.fit(corpora.event_sequences(_table(spark, sf_dir, "events")), LENGTH)


def _name(ngram: str = "ngram", k: str = "k") -> Column:
    """The tokens with blanks between; hardly any key holds what is escaped, and lambdas run outside of generated code."""
    plain = F.instr(F.col(ngram), keys.ESC) == 0
    return F.when(plain, F.replace(F.col(ngram), F.lit(keys.SEP), F.lit(" "))).otherwise(F.array_join(keys.tokens(F.col(ngram), F.col(k)), " ")).alias("ngram")


def _rounded(name: str) -> Column:
    """Adding 0 makes a negative zero positive."""
    return (F.round(name, DIGITS) + F.lit(0.0)).alias(name)


# Counting


@_query
def ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).counts.select("k", _name(), "count", "back_count")


@_query
def ngram_count_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("freq", 1 + F.col("doc_id") % 3)
    return C.count(rows, LENGTH).select("k", _name(), "count", "back_count")


@_query
def ngram_length_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("ngram_length", F.when(F.col("doc_id") % 2 == 0, F.lit(2)))
    return C.count(rows, LENGTH).select("k", _name(), "count", "back_count")


@_query
def ngram_count_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, LONG).counts.select("k", _name(), "count", "back_count")


@_query
def root_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).counts.where("k = 0").select("count", "back_count")


@_query
def unigram_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the markers count: each of them in one direction only."""
    found = _model(spark, sf_dir).counts.where(F.col("ngram").isin(*keys.MARKERS) & (F.col("k") == 1))
    return found.select(F.when(F.col("ngram") == keys.START, "start").otherwise("end").alias("marker"), "count", "back_count")


@_query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vocabulary(_model(spark, sf_dir).counts).select("k", _name(), "count")


@_query
def vocabulary_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vocabulary(_model(spark, sf_dir).counts, markers=False).select("k", _name(), "count")


@_query
def leaf_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).leaves().select("k", _name(), "count")


@_query
def max_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.max_depth(_model(spark, sf_dir).counts)


@_query
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).prune(1).counts.select("k", _name(), "count", "back_count")


@_query
def prune_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).pruned_leaves(1).select("k", _name(), "count")


@_query
def prune_hapax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).pruned_hapax().select("k", _name(), "count")


@_query
def prune_then_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is pruned between two batches of sentences."""
    return _model(spark, sf_dir).prune(1).add(_items(spark, sf_dir)).counts.select("k", _name(), "count", "back_count")


@_query
def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is saved, opened again and goes on learning."""
    folder = shared_folder(spark, "model")
    NgramModel.fit(_items(spark, sf_dir), LENGTH).save(folder)
    return NgramModel.load(spark, folder).add(_lines(spark, sf_dir)).counts.select("k", _name(), "count", "back_count")


def _item_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of benchmark as a stream."""
    schema = _table(spark, sf_dir, "benchmark").schema
    # A pattern, as a stream's path without one is to be a folder.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/benchmark*.parquet")
    return corpora.lines_of(rows.withColumnRenamed("item_id", "doc_id"))


@_query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of a stream, as of its end."""
    folder = shared_folder(spark, "counts")
    step = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table")
    running = training.counts(_item_stream(spark, sf_dir), LENGTH).writeStream.outputMode("complete").foreachBatch(step)
    running.option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("k", _name(), "count", "back_count")


@_query
def stream_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that grows with a stream and is pruned after each batch; the table is one batch."""
    folder = shared_folder(spark, "training")
    training.train_batches(_item_stream(spark, sf_dir), f"{folder}/model", f"{folder}/mark", LENGTH, prune=1).awaitTermination()
    return training.latest(spark, f"{folder}/model", LENGTH).counts.select("k", _name(), "count", "back_count")


@_query
def merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = NgramModel.fit(_items(spark, sf_dir), LENGTH)
    return _model(spark, sf_dir).merge(other).counts.select("k", _name(), "count", "back_count")


@_query
def bare_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of n-grams without markers: the roles of each conversation, as one n-gram."""
    roles = corpora.turns_of(_table(spark, sf_dir, "conversations")).select(F.col("tokens").alias("ngram"))
    return C.count_ngrams(roles).select("k", _name(), "count")


@_query
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of the counts of event types by those of roles."""
    events = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count"))
    roles = _table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("name")).agg(F.count("*").alias("count"))
    return models.merge_counts(events.unionByName(roles), events, ["name"])


# Statistics


@_query
def fwd_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.direction(_model(spark, sf_dir).entropies()).select("k", _name(), _rounded("entropy"))


@_query
def bwd_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.direction(_model(spark, sf_dir).entropies(), back=True).select("k", _name(), _rounded("entropy"))


@_query
def entropy_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).mean_entropies().select("k", _name(), _rounded("entropy"))


@_query
def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).scores.select("k", _name(), _rounded("ev"))


@_query
def norm_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).normalisation().select("direction", "k", _rounded("mean"), _rounded("stdev"))


@_query
def autonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).scores.select("k", _name(), _rounded("autonomy"))


@_query
def autonomy_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, LONG).scores.select("k", _name(), _rounded("entropy"), _rounded("autonomy"))


@_query
def autonomy_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).scores.select("k", _name(), _rounded("centred"))


@_query
def root_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).root_entropy().select(_rounded("entropy"))


@_query
def event_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).counts.select("k", _name(), "count", "back_count")


@_query
def event_autonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).scores.select("k", _name(), _rounded("entropy"), _rounded("ev"), _rounded("autonomy"))


@_query
def turn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpora.turns_of(_table(spark, sf_dir, "conversations"))
    return C.count(turns, LENGTH).select("k", _name(), "count", "back_count")


# Lookups and lexicons


@_query
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model of documents says of all slices of benchmark's lines, unknown ones included."""
    asked = lexicon.candidates(_items(spark, sf_dir), LENGTH)
    found = _model(spark, sf_dir).query(asked)
    return found.select(F.array_join("ngram", " ").alias("ngram"), "count", *(_rounded(m) for m in S.MEASURES))


@_query
def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct slices of the corpus with their autonomy, as the lexicon of its own model."""
    found = _model(spark, sf_dir).lexicon(longest=ORDER, markers=False)
    return found.select(F.array_join("ngram", " ").alias("ngram"), _rounded("autonomy"), "count")


@_query
def lexicon_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the lexicon, a report."""
    found = _model(spark, sf_dir).lexicon().select(F.array_join("ngram", " ").alias("ngram"), _rounded("autonomy"), "count")
    return found.orderBy(F.desc("autonomy"), "ngram").limit(TOP)


@_query
def lexicon_topk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexicon_topk, with the default length."""
    found = _model(spark, sf_dir, LONG).lexicon().select(F.array_join("ngram", " ").alias("ngram"), _rounded("autonomy"), "count")
    return found.orderBy(F.desc("autonomy"), "ngram").limit(TOP)


@_query
def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.formatted(_events(spark, sf_dir).lexicon())


@_query
def model_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon, as lines of text and read from those."""
    lines = models.format_tsv(_events(spark, sf_dir).lexicon(), " ")
    return models.parse_tsv(lines, " ").select("k", _name(), _rounded("autonomy"), "count")


def _chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of benchmark with some letters as Chinese characters."""
    return _table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", CJK_FROM, CJK_TO).alias("text"))


@_query
def model_csv_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of raw text, as lines without a delimiter between characters and read from those."""
    model = NgramModel.fit(corpora.chunks_of(_chinese(spark, sf_dir), "text"), LENGTH)
    lines = models.format_tsv(model.lexicon(model.vocabulary(markers=False)))
    return models.parse_tsv(lines).select("k", _name(), _rounded("autonomy"), "count")


# Tokens


@_query
def unicode_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.category_runs(F.col("text"))).alias("run", "piece"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("piece")).alias("characters"), F.max(F.length("piece")).alias("longest"))


@_query
def unicode_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.explode(tokens.category_runs(F.col("text"))).alias("piece"))
    return rows.groupBy(tokens.category(F.col("piece")).alias("category")).agg(F.count("*").alias("runs"))


@_query
def cjk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of CJK characters of texts with such characters around their words."""
    rows = _table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.lit("我们 "), F.replace("text", F.lit("a"), F.lit(" 中文\U00020000 ")), F.lit("々〇")))
    return rows.select("item_id", F.array_join(tokens.cjk_chunks(F.col("text")), "|").alias("chunks"))


@_query
def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.whitespace_tokens(F.col("text"))).alias("words"), F.size(tokens.space_tokens(F.col("text"))).alias("parts"), F.size(tokens.characters(F.col("text"))).alias("characters"))


@_query
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return lines.groupBy("doc_id").agg(F.count_if(tokens.is_blank(F.col("value"))).alias("blank"), F.count("*").alias("lines"))


@_query
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.nfc(F.replace("text", F.lit("e"), F.lit("é"))).alias("text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark as words of two tokens each."""
    lines = _items(spark, sf_dir)
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 2)), lambda i: F.slice("tokens", (i * 2 + 1).cast("int"), F.lit(2)))
    return lines.select("doc_id", "line", pairs.alias("words"))


@_query
def bies_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "line", tags.format_bies(F.col("words")).alias("tagged"))


@_query
def token_in_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "line", tags.format_token_in_word(F.col("words")).alias("tagged"))


@_query
def token_in_word_bies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "line", tags.format_token_in_word_bies(F.col("words")).alias("tagged"))


@_query
def add_bies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _items(spark, sf_dir).select(F.explode("tokens").alias("word")).distinct()
    return words.select("word", F.array_join(tags.character_bies(F.col("word")), " ").alias("tagged"))


# Segmentation


@_query
def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents by the model of documents."""
    lines = _lines(spark, sf_dir)
    cut = G.segment(lines, NgramModel.fit(lines, LENGTH).scores, ORDER)
    return cut.select("doc_id", "line", F.array_join(F.transform("words", lambda w: F.array_join(w, "_")), " ").alias("segmented"))


@_query
def segment_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of benchmark by the model of documents."""
    cut = G.segment(_items(spark, sf_dir), _model(spark, sf_dir).scores, ORDER)
    return cut.select("doc_id", "line", F.array_join(F.transform("words", lambda w: F.array_join(w, "_")), " ").alias("segmented"))


@_query
def segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.event_sequences(_table(spark, sf_dir, "events"))
    cut = G.segment(rows, NgramModel.fit(rows, LENGTH).scores, ORDER)
    return cut.select("user_id", tags.format_bies(F.col("words")).alias("tagged"))


@_query
def segment_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of benchmark by the model of documents at the default length, in words of up to four tokens."""
    cut = G.segment(_items(spark, sf_dir), _model(spark, sf_dir, LONG).scores, G.check_order(None, LONG))
    return cut.select("doc_id", "line", F.array_join(F.transform("words", lambda w: F.array_join(w, "_")), " ").alias("segmented"))


@_query
def bies_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = G.segment(_items(spark, sf_dir), _model(spark, sf_dir, LONG).scores, G.check_order(None, LONG))
    return cut.select("doc_id", "line", tags.format_bies(F.col("words")).alias("tagged"))


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpora.event_sequences(_table(spark, sf_dir, "events"))
    return G.segment_nbest(rows, NgramModel.fit(rows, LENGTH).scores, ORDER, NBEST)


@_query
def segment_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentations of each user's events."""
    found = _several(spark, sf_dir).select("user_id", F.posexplode("nbest").alias("rank", "s"))
    return found.select("user_id", "rank", (F.round("s.score", DIGITS) + 0.0).alias("score"), F.array_join(F.transform("s.words", lambda w: F.array_join(w, "_")), " ").alias("segmented"))


@_query
def nbest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.nbest_lines(_several(spark, sf_dir), "user_id")


@_query
def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of benchmark as a stream, by their own model."""
    folder = shared_folder(spark, "segments")
    scores = NgramModel.fit(_items(spark, sf_dir), LENGTH).scores
    training.segment_stream(_item_stream(spark, sf_dir), scores, ORDER, f"{folder}/table", f"{folder}/mark").awaitTermination()
    cut = spark.read.parquet(f"{folder}/table")
    return cut.select("doc_id", "line", F.array_join(F.transform("words", lambda w: F.array_join(w, "_")), " ").alias("segmented"))


@_query
def segment_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text: runs of Chinese characters are segmented, others stay."""
    rows = _chinese(spark, sf_dir)
    found = preprocess.segment_text(rows, NgramModel.fit(corpora.chunks_of(rows, "text"), LENGTH).scores, ORDER)
    return found.select("item_id", "segmented")


@_query
def tag_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of benchmark, split at blanks, with each token tagged by its word in the model of documents."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    tagged = preprocess.tag_sentences(rows, _model(spark, sf_dir).scores, ORDER, "token_in_word_bies")
    return tagged.select("item_id", "line", "tagged")
