"""Readers, writers, streams and the command line."""

import io

import pytest
from pyspark.sql import functions as F

from ngramforge import cli
from ngramforge.operators import counts as C
from ngramforge.operators import lexicon
from ngramforge.plans.model import NgramModel
from ngramforge.sources import corpora, models
from ngramforge.streaming import training

SENTENCES = ["small black cat", "a red cat", "black cat", "a small dog", "black cat and dog"]


def rows(counts):
    return sorted(map(tuple, counts.select(*C.COUNTS).collect()))


def sentences(spark, lines=SENTENCES):
    return spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "id long, tokens array<string>")


def test_tsv(spark, tmp_path):
    found = NgramModel.fit(sentences(spark), 3).lexicon()
    want = {tuple(r.ngram): (r.autonomy, r["count"]) for r in found.collect()}
    models.write_tsv(found, str(tmp_path / "tsv"), " ")
    read = models.read_tsv(spark, str(tmp_path / "tsv"), " ")
    got = {tuple(r.ngram): (r.autonomy, r["count"]) for r in read.query(spark.createDataFrame([(list(g),) for g in want], "ngram array<string>")).collect()}
    assert got.keys() == want.keys() and read.default_ngram_length == 3
    # Sums of the same numbers in another order differ in the last digits.
    assert all(abs(got[g][0] - want[g][0]) < 1e-9 and got[g][1] == want[g][1] for g in want)
    models.write_parquet(found, str(tmp_path / "parquet"))
    again = models.read_parquet(spark, str(tmp_path / "parquet"))
    assert again.query_autonomy(["black", "cat"]) == pytest.approx(read.query_autonomy(["black", "cat"]))
    assert again.query_count(["no", "one"]) == 0 and again.query_autonomy(["no", "one"]) is None


def test_tsv_of_characters_and_repeats(spark):
    lines = spark.createDataFrame([("北京\t1.5\t3",), ("北京\t2.5\t4",), ("好\t-1\t2",), ("",)], "value string").coalesce(1)
    read = models.ScoredModel(models.parse_tsv(lines))
    assert read.query_autonomy(["北", "京"]) == 2.5 and read.query_count(["北", "京"]) == 4 and read.default_ngram_length == 3


def test_lexicon(spark):
    s = sentences(spark)
    found = NgramModel.fit(s, 3).lexicon(lexicon.candidates(s, 2))
    lines = [r.value for r in lexicon.formatted(found, "_").collect()]
    values = [float(x.split("\t")[1]) for x in lines]
    assert values == sorted(values, reverse=True) and any(x.startswith("black_cat\t") for x in lines)


def test_xml(spark, tmp_path):
    page = "<mediawiki>" + "".join(f"<page><revision><text>{t}</text></revision></page>" for t in ("One two. Three", "Vier-fünf sechs.")) + "</mediawiki>"
    (tmp_path / "dump.xml").write_text(page)
    assert sorted(r.tokens for r in corpora.xml_sentences(spark, str(tmp_path / "dump.xml")).collect()) == [["one", "two"], ["three"], ["vier-fünf", "sechs"]]


def test_limits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y\nz\n\nq\n")
    assert corpora.lines(spark, str(tmp_path / "a.txt"), 2).count() == 2 and corpora.lines(spark, str(tmp_path / "a.txt")).count() == 4
    assert [r.tokens for r in corpora.sentences_of(corpora.lines(spark, str(tmp_path / "a.txt"))).collect()] == [["x", "y"], ["z"], [], ["q"]]


def test_numbers_follow_files_and_places(spark, tmp_path):
    want = []
    for name, n in (("b", 900), ("a", 40), ("c", 7)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    for name, n in (("a", 40), ("b", 900), ("c", 7)):
        want += [f"{name}{i}" for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        got = corpora.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
        first = sorted(r.value for r in corpora.lines(spark, str(tmp_path), 43).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == list(enumerate(want)) and first == sorted(want[:43])
    rows = spark.createDataFrame([(x,) for x in want], "value string").repartition(5)
    assert sorted(r.line for r in corpora.numbered(rows).collect()) == list(range(len(want)))


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    out = corpora.table(spark, str(tmp_path / "one"))
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in out.collect()) == list(range(100))


def test_standard_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.sys, "stdin", io.StringIO("\n".join(SENTENCES)))
    cli.main(["lexicon", "-", str(tmp_path / "words"), "-o", "2", "-s", "+"], spark)
    assert any(x.startswith("black+cat\t") for x in read(tmp_path / "words"))
    folder = corpora.piped(spark, io.StringIO("a\nb\n\nc"), str(tmp_path / "piped"), 2)
    assert [tuple(r) for r in corpora.numbered_lines(spark, folder).orderBy("line").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    assert corpora.numbered_lines(spark, corpora.piped(spark, [], str(tmp_path / "nothing"))).count() == 0


def test_vocabulary_of_a_pruned_model(spark, tmp_path):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("我爱北京\n北京很大\n他爱北京\n北京好\n北京\n" * 3)
    cli.main(["train", str(corpus), "-m", str(tmp_path / "voc"), "-l", "3", "-p", "1", "-L", "0", "--vocabulary", "-s", " "], spark)
    got = {x.split("\t")[0]: int(x.split("\t")[2]) for x in read(tmp_path / "voc")}
    assert got["北 京"] == 15


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "ngram string, count long") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, models.merge_counts(old, new, ["ngram"]).collect())) == [("a", 1), ("b", 5), ("c", 4)]


def stream(spark, folder, lines=SENTENCES):
    for i, x in enumerate(lines):
        spark.createDataFrame([(i, x.split())], "id long, tokens array<string>").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, tokens array<string>").option("maxFilesPerTrigger", 2).parquet(folder)


def test_running_counts(spark, tmp_path):
    live = training.counts(stream(spark, str(tmp_path / "in")), 3)
    query = live.writeStream.format("memory").queryName("live_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("live_counts")) == rows(C.count(sentences(spark), 3))


def test_trained_by_batches(spark, tmp_path):
    source, path = stream(spark, str(tmp_path / "in")), str(tmp_path / "model")
    training.train_batches(source, path, str(tmp_path / "mark"), 3).awaitTermination(120)
    model = training.latest(spark, path, 3)
    assert rows(model.counts) == rows(C.count(sentences(spark), 3))
    assert rows(training.latest(spark, str(tmp_path / "none"), 3).counts) == []


def test_pruned_between_batches_and_repeated(spark, tmp_path):
    path = str(tmp_path / "model")
    parts = [sentences(spark, SENTENCES[:2]), sentences(spark, SENTENCES[2:])]
    for version, part in enumerate(parts):
        training.add_batch(part, version, path, 3, prune=1)
        first = rows(training.latest(spark, path, 3).counts)
        training.add_batch(part, version, path, 3, prune=1)
        assert rows(training.latest(spark, path, 3).counts) == first
    want = C.prune(C.merge(C.prune(C.count(parts[0], 3)), C.count(parts[1], 3)))
    assert first == rows(want)


def test_segmented_stream(spark, tmp_path):
    scores = NgramModel.fit(sentences(spark), 3).scores
    training.segment_stream(stream(spark, str(tmp_path / "in")), scores, 2, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = {r.id: [t for w in r.words for t in w] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: x.split() for i, x in enumerate(SENTENCES)}


def read(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_command_line(spark, tmp_path):
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("我爱北京\n北京很大，abc\n\n他爱北京\n北京好\n")
    cli.main(["train", str(corpus), "-m", str(tmp_path / "model"), "-l", "3"], spark)
    assert any(x.startswith("北京\t") for x in read(tmp_path / "model"))
    cli.main(["segment", str(corpus), "-m", str(tmp_path / "model"), "-t", str(tmp_path / "one")], spark)
    cli.main(["segment", str(corpus), "-l", "3", "-t", str(tmp_path / "two")], spark)
    cli.main(["segment", str(corpus), "-l", "3", "-t", str(tmp_path / "three"), "--bies"], spark)
    assert read(tmp_path / "one") == read(tmp_path / "two") and len(read(tmp_path / "one")) == 4
    assert "北-B 京-E" in read(tmp_path / "three")[0]
    cli.main(["nbest", str(corpus), "-l", "3", "-t", str(tmp_path / "four"), "-n", "2"], spark)
    assert read(tmp_path / "four")
    words = tmp_path / "words.txt"
    words.write_text("\n".join(SENTENCES))
    cli.main(["lexicon", str(words), str(tmp_path / "five"), "-o", "2", "-s", "+"], spark)
    assert any(x.startswith("black+cat\t") for x in read(tmp_path / "five"))


def test_pruned_training(spark, monkeypatch):
    monkeypatch.setattr(cli, "BATCH", 2)
    lines = spark.createDataFrame([("北京",), ("北京",), ("北京",), ("上海",), ("好",)], "value string").coalesce(1)
    model, chunks = cli.train(lines, 2, prune=1)
    assert chunks.count() == 5
    assert [model.query_count(list(x)) for x in ("北京", "上海", "好")] == [1, 0, 1]
    with pytest.raises(SystemExit):
        cli.main(["train", "x"])
    assert cli.train(lines, 2, size=1)[0].counts.where(F.col("k") == 0).first()["count"] == 3
