"""Segmentation, tags and raw text."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ngramforge.functions import tags, tokens
from ngramforge.operators import preprocess
from ngramforge.operators.segment import best, best_several, check_order, segment, segment_nbest
from ngramforge.plans.model import NgramModel

DOGS = ["hot dog ou sandwich", "hot dog ou pas", "j ador les hot dog", "je vous parle de hot dog"]


def model(spark, lines, n):
    return NgramModel.fit(spark.createDataFrame([(x.split(),) for x in lines], "tokens array<string>"), n)


def cut(spark, scores, order, lines):
    rows = spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "id int, tokens array<string>")
    return [["_".join(w) for w in r.words] for r in segment(rows, scores, order).orderBy("id").collect()]


def test_dogs(spark):
    lines = ["je deteste les hot dog", "un chat noir et blanc", ""]
    assert cut(spark, model(spark, DOGS, 3).scores, 2, lines) == ["je deteste les hot_dog".split(), lines[1].split(), []]
    assert cut(spark, model(spark, DOGS, 2).scores, check_order(None, 2), lines[:1]) == [lines[0].split()]


def test_new_york(spark):
    corpus = ["New York is a fine city", "potatoes are fine", "I like New York city", "I like potatoes"]
    assert cut(spark, model(spark, corpus, 5).scores, 4, ["What do you know about New York"]) == ["What do you know about New_York".split()]


def test_best_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        n, order = rng.randint(1, 7), rng.randint(1, 4)
        score = {(i, k): rng.choice([-2.0, -0.5, 0.25, 1.0]) for i in range(n) for k in range(1, order + 1) if i + k <= n and rng.random() < 0.7}
        ways = [w for m in range(1, n + 1) for w in itertools.product(range(1, order + 1), repeat=m) if sum(w) == n]

        def total(way, unknown):
            at = s = 0
            for k in way:
                s += score[at, k] * k if (at, k) in score else unknown(k)
                at += k
            return s

        found = best(n, order, score)
        assert sum(found) == n and abs(total(found, lambda k: -100 * k) - max(total(w, lambda k: -100 * k) for w in ways)) < 1e-9
        several = best_several(n, order, score, 3)
        top = sorted(total(w, lambda k: -100) for w in ways)[-3:]
        assert [round(s, 6) for s, _ in several] == [round(s, 6) for s in top]
        assert len({tuple(w) for _, w in several}) == len(several)


def test_orders():
    assert check_order(None, 5) == 4 and check_order(3, 5) == 3
    for bad in ((None, 1), (1, 5), ("2", 5)):
        with pytest.raises(ValueError):
            check_order(*bad)


def test_several(spark):
    rows = spark.createDataFrame([(1, "les hot dog".split()), (2, []), (3, None)], "id int, tokens array<string>")
    got = {r.id: r.nbest for r in segment_nbest(rows, model(spark, DOGS, 3).scores, 2, 3).collect()}
    assert got[3] is None and len(got[1]) == 3
    assert [s.score for s in got[1]] == sorted(s.score for s in got[1])
    with pytest.raises(ValueError):
        segment_nbest(rows, model(spark, DOGS, 3).scores, 2, 0)


def test_extra_columns_and_long_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b"] * 3000, "x")], "id int, tokens array<string>, words string")
    out = segment(rows.drop("words"), model(spark, ["a b", "b a"], 3).scores, 2).first()
    assert sum(map(len, out.words)) == 6000


def test_rows_that_no_id_tells_apart(spark):
    scores = model(spark, DOGS, 3).scores
    schema = "id int, tokens array<string>, _t string, _spans string, _key string, text string"
    rows = [(1, "les hot dog"), (1, "hot dog les"), (None, "les hot dog"), (None, None), (2, ""), (3, "les ? hot dog")]
    table = spark.createDataFrame([(i, None if x is None else [None if w == "?" else w for w in x.split()], "a", "b", "c", x) for i, x in rows], schema)
    out = segment(table, scores, 2)
    assert out.columns == [*table.columns, "words"]
    got = sorted((str(r.id), str(r.text), str(r.words and [" ".join(map(str, w)) for w in r.words])) for r in out.collect())
    assert got == sorted([("1", "les hot dog", "['les', 'hot dog']"), ("1", "hot dog les", "['hot dog', 'les']"), ("None", "les hot dog", "['les', 'hot dog']"), ("None", "None", "None"), ("2", "", "[]"), ("3", "les ? hot dog", "['les', 'None', 'hot dog']")])
    assert {(r._t, r._spans, r._key) for r in out.collect()} == {("a", "b", "c")}
    many = segment_nbest(table, scores, 2)
    assert sorted(str(r.id) for r in many.collect()) == sorted(str(i) for i, _ in rows)
    cjk = model(spark, ["我 爱 北 京", "北 京 很 大"], 3).scores
    lines = spark.createDataFrame([(1, "我爱北京", "x"), (1, "北京a", "x"), (None, "北京a", "x"), (None, None, "x")], "id int, text string, key string")
    got = sorted((str(r.id), str(r.text), str(r.segmented), r.key) for r in preprocess.segment_text(lines, cjk, 2, bies=False).collect())
    assert [g[2].replace(" ", "") for g in got] == ["北京a", "我爱北京", "None", "北京a"] and {g[3] for g in got} == {"x"}
    tagged = preprocess.tag_sentences(lines.withColumnRenamed("key", "tokens").withColumn("words", F.lit(1)), cjk, 2)
    assert tagged.columns == ["id", "text", "tokens", "words", "tagged"] and tagged.count() == 4


def test_tags(spark):
    rows = spark.createDataFrame([([["hot", "dog", "s"], ["a"], ["b", "c"]],)], "w array<array<string>>")
    got = rows.select(tags.format_bies("w"), tags.format_token_in_word("w"), tags.format_token_in_word_bies(F.col("w")), tags.character_bies(F.lit("很好吃")), tags.character_bies(F.lit(""))).first()
    assert got[0] == "hot-B dog-I s-E a-S b-B c-E"
    assert got[1] == "hot-_dogs dog-hot_s s-hotdog_ a-_ b-_c c-b_"
    assert got[2] == "hot-_dogs-B dog-hot_s-I s-hotdog_-E a-_-S b-_c-B c-b_-E"
    assert got[3] == ["很-B", "好-I", "吃-E"] and got[4] == []


def test_categories(spark):
    texts = ["Ab c-12", "漢字カナ", "々", "〇", "é́x", "\U00020000a", "", "  ", "中文abc，好"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    got = [(r.a, r.b) for r in rows.orderBy("i").select(tokens.category_runs(F.col("s")).alias("a"), tokens.cjk_chunks(F.col("s")).alias("b")).collect()]
    assert [a for a, _ in got] == [["Ab", " ", "c", "-", "12"], ["漢字カナ"], ["々"], ["〇"], ["é", "́", "x"], ["\U00020000", "a"], [], ["  "], ["中文", "abc", "，", "好"]]
    assert [b for _, b in got] == [[], ["漢字カナ"], [], [], [], ["\U00020000"], [], [], ["中文", "好"]]
    kinds = spark.createDataFrame([("A",), ("z",), ("中",), ("1",), (" ",), ("͸",), ("",)], "c string").select("c", tokens.category(F.col("c")).alias("k")).collect()
    assert {r.c: r.k for r in kinds} == {"A": "latin", "z": "latin", "中": "Lo", "1": "Nd", " ": "Zs", "͸": "Cn", "": None}


def test_tokenizers(spark):
    row = spark.createDataFrame([(" a　b  c\t\n", "x.y\n\nz")], "s string, t string").select(
        tokens.whitespace_tokens(F.col("s")).alias("w"), tokens.space_tokens(F.col("s")).alias("p"), tokens.strip(F.col("s")).alias("t"), tokens.is_blank(F.lit("　\t")).alias("b"), tokens.sentences(F.col("t")).alias("n"), tokens.word_tokens(F.lit("l'été_1, 2")).alias("r"), tokens.nfc(F.lit("é")).alias("c"), tokens.characters(F.lit("a\U00020000")).alias("x")
    ).first()
    assert row.w == ["a", "b", "c"] and row.p == ["", "a　b", "", "c\t\n"] and row.t == "a　b  c" and row.b
    assert row.n == ["x", "y", "z"] and row.r == ["l", "été_1", "2"] and row.c == "é" and row.x == ["a", "\U00020000"]


def test_raw_text(spark):
    corpus = ["我爱北京", "北京很大", "他爱北京", "北京好"]
    scores = NgramModel.fit(spark.createDataFrame([(list(x),) for x in corpus], "tokens array<string>"), 3).scores
    rows = spark.createDataFrame([(1, "我爱北京 abc!"), (2, ""), (3, None), (4, "only latin")], "id int, text string")
    plain = {r.id: r.segmented for r in preprocess.segment_text(rows, scores, 2, bies=False).collect()}
    tagged = {r.id: r.segmented for r in preprocess.segment_text(rows, scores, 2).collect()}
    assert plain[2] == "" and plain[3] is None and plain[4] == "only   latin"
    assert plain[1].replace(" ", "") == "我爱北京abc!" and "北京" in plain[1].split(" ")
    assert "北-B 京-E" in tagged[1] and tagged[1].endswith("a-B b-I c-E !-S")


def test_tagged_sentences(spark):
    rows = spark.createDataFrame([(1, "les hot dog"), (2, ""), (3, None)], "id int, text string")
    got = {style: {r.id: r.tagged for r in preprocess.tag_sentences(rows, model(spark, DOGS, 3).scores, 2, style).collect()} for style in preprocess.STYLES}
    assert got["bies"] == {1: "les-S hot-B dog-E", 2: "-S", 3: None}
    assert got["token_in_word"][1] == "les-_ hot-_dog dog-hot_" and got["token_in_word_bies"][1] == "les-_-S hot-_dog-B dog-hot_-E"
    with pytest.warns(UserWarning):
        check_order(5, 3)
