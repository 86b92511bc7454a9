"""Language identification by hierarchical discrimination.

A linear support vector machine tells the families apart (one against the rest where there are
more than two), then one-versus-one machines vote among the languages of the family.  Features are
hashed character trigrams with the word's edges, relative to the root of their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ngramforge.llm.common import SLICE_BYTES, column, give_back, slices, table, unused

FAMILIES = {"germanic": ("de", "en", "nl", "sv", "da"), "romance": ("es", "fr", "it", "pt", "ro")}
#: Labelled rows of each language that the machines are fitted to: bounds the sample at any input size.
SAMPLE_ROWS = 300
BUCKETS = 1 << 14
#: A text is rejected where its letters are fewer than this share of what is no white space, or the family's score is below MARGIN.
LETTERS = 0.3
MARGIN = 0.002
#: A text's margin is 0 where fewer of its trigrams are known from fitting than SLACK times what all but this share of the sample's texts have in common with the others.
STRANGE = 0.01
SLACK = 0.9

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_LETTER] = 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram, starting at each position but the last two; ASCII capitals count as small, all that is no letter as a blank."""
    x = _FOLD[data].astype(np.uint32)
    key = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)


def scores(texts: pa.Array, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision values (document, machine) and the share of letters in each text.

    weights: (BUCKETS, machines).  A document's value is the sum of its trigrams' weights by the
    root of their number, plus bias.
    """
    flat = texts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    values = np.tile(bias, (len(size), 1))

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
        return total

    if len(data) >= 3:
        bucket = trigrams(data)
        ends = np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(bucket))
        starts = np.minimum(offsets[:-1], len(bucket))
        n = ends - starts
        for k in range(weights.shape[1]):
            total = per_text(weights[:, k][bucket])
            values[:, k] += (total[ends] - total[starts]) / np.sqrt(np.maximum(n, 1))
    letters, blank = per_text(_LETTER[data]), per_text(_SPACE[data])
    seen = size - (blank[offsets[1:]] - blank[offsets[:-1]])
    share = (letters[offsets[1:]] - letters[offsets[:-1]]) / np.maximum(seen, 1)
    return values, np.where(seen > 0, share, 0.0)


def features(text: str) -> np.ndarray:
    """BUCKETS counts by the root of their number."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.float32)
    return (np.bincount(trigrams(data), minlength=BUCKETS) / np.sqrt(len(data) - 2)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine for y of -1 and 1; accelerated gradient steps from zero, classes weighted alike."""
    share = np.where(y > 0, 0.5 / max(1, int((y > 0).sum())), 0.5 / max(1, int((y < 0).sum()))).astype(np.float32)
    x1 = np.hstack((x, np.ones((len(x), 1), np.float32)))
    step = 1.0 / (2 * float((share * (x1**2).sum(axis=1)).sum()) + penalty)
    w = last = np.zeros(x1.shape[1], np.float32)
    for k in range(rounds):
        ahead = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x1 @ ahead)) * share
        last, w = w, ahead - step * (penalty * ahead - 2 * (x1.T @ (y * slack)))
    return w[:-1], float(w[-1])


class Model:
    """The machines of one set of languages."""

    def __init__(self, labels: list[str], x: np.ndarray, families: dict[str, tuple[str, ...]] = FAMILIES):
        """x: the features of a labelled text in each row."""
        of = {lang: name for name, members in families.items() for lang in members}
        self.family_of = {lang: of.get(lang, lang) for lang in sorted(set(labels))}
        self.families = sorted(set(self.family_of.values()))
        tag = np.array(labels)
        family = np.array([self.family_of[lang] for lang in labels])
        texts = (x > 0).sum(axis=0)
        self.seen = (texts > 0).astype(np.float32)
        common = (x @ (texts > 1).astype(np.float32)) / np.maximum(x.sum(axis=1), 1e-9)
        self.least = SLACK * float(np.quantile(common, STRANGE)) if len(x) > 1 else 0.0
        heads: list[tuple[np.ndarray, float]] = []
        if len(self.families) == 2:
            heads.append(fit_svm(x, np.where(family == self.families[0], 1, -1).astype(np.float32)))
        elif len(self.families) > 2:
            heads += [fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families]
        self.n_heads = len(heads)
        self.pairs = [(a, b) for f in self.families for a, b in combinations([la for la in self.family_of if self.family_of[la] == f], 2)]
        for a, b in self.pairs:
            own = (tag == a) | (tag == b)
            heads.append(fit_svm(x[own], np.where(tag[own] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack([w for w, _ in heads], axis=1) if heads else np.zeros((BUCKETS, 0), np.float32)
        self.bias = np.array([b for _, b in heads])

    def known(self, seen: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a text of n trigrams, of them seen in fitting, is of the languages fitted; three deviations below least are left to chance, as each byte stands in three trigrams."""
        n = np.maximum(n, 1)
        return seen / n >= self.least - 3 * np.sqrt(3 * self.least * (1 - self.least) / n)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Family, language, margin and letters' share.  The margin is the least distance from a decision that was made, and 0 for a text that is strange to all languages fitted; ties of votes go to the higher sum of distances, then to the first name."""
        values, letters = scores(texts, np.column_stack((self.weights, self.seen)), np.append(self.bias, 0.0))
        n = len(letters)
        long = np.maximum(pc.binary_length(texts.cast(pa.large_binary())).to_numpy(zero_copy_only=False) - 2, 0)
        known = self.known(values[:, -1] * np.sqrt(np.maximum(long, 1)), long)
        values = values[:, :-1]
        if not self.families:
            return np.full(n, None, object), np.full(n, None, object), np.zeros(n), letters
        head = values[:, : self.n_heads]
        if self.n_heads == 0:
            pick, sure = np.zeros(n, int), np.full(n, np.inf)
        elif self.n_heads == 1:
            pick, sure = (head[:, 0] <= 0).astype(int), np.abs(head[:, 0])
        else:
            pick = head.argmax(axis=1)
            ranked = np.sort(head, axis=1)
            sure = ranked[:, -1] - ranked[:, -2]
        names = list(self.family_of)
        votes = np.zeros((n, len(names)))
        for (a, b), v in zip(self.pairs, values[:, self.n_heads :].T, strict=True):
            for lang, s in ((a, v), (b, -v)):
                votes[:, names.index(lang)] += (s > 0) + np.tanh(s) * 1e-3
        inside = np.array([[self.family_of[lang] == f for lang in names] for f in self.families])
        lang = np.where(inside[pick], votes, -np.inf).argmax(axis=1)
        for (a, b), v in zip(self.pairs, values[:, self.n_heads :].T, strict=True):
            mine = (lang == names.index(a)) | (lang == names.index(b))
            sure = np.where(mine, np.minimum(sure, np.abs(v)), sure)
        return np.array(self.families, object)[pick], np.array(names, object)[lang], np.where(known, np.where(np.isfinite(sure), sure, 1.0), 0.0), letters


def sample(docs: DataFrame, label: str, rows: int) -> DataFrame:
    """(label, h, buckets, values): the features of at most that many labelled rows of each language, least hash of the text first.

    Whole texts are read, by the executors; what they give has a bounded size whatever the texts'.
    Rows with a null label and null or empty texts are no sample; rows that repeat a label and a
    text count once; further columns are left out.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col(label).alias("label"), F.col("text").alias("text"), F.xxhash64("text").alias("h"))
    best = Window.partitionBy("label").orderBy("h")
    edge = known.select("label", "h").distinct().withColumn("i", F.row_number().over(best)).where(F.col("i") <= rows).groupBy("label").agg(F.max("h").alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [features(t) for t in part.column("text").to_pylist()]
            some = [np.flatnonzero(v).astype(np.int32) for v in x]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("h"), pa.array([i.tobytes() for i in some], pa.binary()), pa.array([v[i].tobytes() for v, i in zip(x, some, strict=True)], pa.binary())],
                names=["label", "h", "buckets", "values"],
            )
        give_back()

    # A row for each language, so it may be broadcast at any input size.
    chosen = known.join(F.broadcast(edge), "label").where(F.col("h") <= F.col("top")).select("label", "h", "text")
    return chosen.mapInArrow(run, "label string, h long, buckets binary, values binary").dropDuplicates(["label", "h"])


def fit(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Machines fitted by the driver to the bounded sample; a language of no family is one by itself.

    The sample is taken in the order of labels and hashes, so the machines do not depend on how
    rows are spread; without any labelled text there are no machines, and nothing has a language.
    """
    got = sorted(sample(docs, label, rows).collect(), key=lambda r: (r.label, r.h))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r.buckets, np.int32)] = np.frombuffer(r.values, np.float32)
    return Model([r.label for r in got], x, families)


NEW = ("_family", "_lang", "_margin", "_accepted")


def identify(docs: DataFrame, model: Model, letters: float = LETTERS, margin: float = MARGIN, names: Sequence[str] = NEW) -> DataFrame:
    """docs with family, language, margin and acceptance under those names; nothing is shuffled.

    A null or empty text, one with few letters, one of trigrams strange to all languages fitted and
    one without a clear family is not accepted; its
    language is null where there is no letter.  Other rows are each judged by themselves, so
    repeated rows and ties get equal answers; all columns of docs stay, null or not; columns of
    docs called like the four new ones are replaced.
    """
    kept = docs.select(*[column(c) for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The running sums take some 30 bytes for each one of the text.
        for part in slices(batches, limit=SLICE_BYTES // 4):
            family, lang, sure, share = shared.value.predict(part.column("text").fill_null(""))
            some = share > 0
            ok = (share >= letters) & (sure >= margin) & some
            extra = [pa.array(np.where(some, family, None), pa.string()), pa.array(np.where(some, lang, None), pa.string()), pa.array(sure), pa.array(ok)]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *names])
        give_back()

    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, k) for c, k in zip(names, (T.StringType(), T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return kept.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows of docs whose language is accepted, with lang set to the language found; without labelled rows all that hold a letter stay.

    Rows are judged by themselves, repeated ones alike; all columns stay, also ones called like
    those of identify(); an empty table gives no rows.
    """
    model = model or fit(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = unused(docs, *NEW)
    judged = identify(docs, model, names=names).where(F.col(names[3]))
    return judged.select(*[F.col(names[1]).alias(c) if c == "lang" else column(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.col("_family").alias("family"), F.col("_lang").alias("lang"), F.col("_margin").alias("margin"), F.col("_accepted").alias("accepted"))
