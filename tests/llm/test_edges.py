"""Empty tables, clashing and dotted column names, very long texts: operators that other files do not cover."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planlab.llm import chats, leaks, licences, mixing, near, quality, rules, substrings, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `REJECTED_BY` string, rid int, `__c` int"


@pytest.fixture(scope="module")
def docs(spark):
    good = [" ".join(f"word{(7 * i + j * j) % 997} and" for j in range(60)) + f" end {i}" for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), i, "mine", 1, 2) for i, t in enumerate(good)] + [(50, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


def benchmark(spark, folder):
    spark.createDataFrame([(1, "what is never said in any of these texts at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_keeps_odd_columns(spark, docs, tmp_path):
    place, now = benchmark(spark, tmp_path), docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, place)
        assert now.columns[: len(docs.columns)] == docs.columns or name == "mixing", name
    assert now.count() > 0 and "a.b" in now.columns and {r["a.b"] for r in now.collect()} <= set(range(12))


def test_pipeline_of_nothing(spark, docs, tmp_path):
    place = benchmark(spark, tmp_path)
    for empty in (docs.limit(0), docs.where("text IS NULL")):
        for _, stage in corpus_pipeline.STAGES:
            empty = stage(spark, empty, place)
        assert empty.count() == 0


def test_an_input_column_of_the_verdicts_name(docs):
    got = rules.verdicts(docs)
    assert [c.lower() for c in got.columns].count("rejected_by") == 1
    assert got.where("rejected_by = 'mine'").count() == 0


def test_operators_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, rule string")
    table = spark.createDataFrame(list(urls.RULES), "verdict string, rule string")
    assert urls.filter_urls(pages, table).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {r.rule for r in urls.filter_urls(some, table.limit(0)).collect()} == {None}
    assert chats.preferences(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string, licence string")
    known = spark.createDataFrame(list(licences.KNOWN), "licence string, text string")
    assert licences.scan(none, known).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(none, labels).count() == 0


def test_quality_without_labels(spark):
    rows = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for labels, score in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        assert {r.score for r in quality.score_quality(rows, frame).collect()} == {score}


def test_turns_are_rendered_in_order(spark):
    """The prompt is the common beginning, each completion what follows, and together they are the conversation."""
    turns = {
        1: [("system", "be brief"), ("user", "hello there"), ("assistant", "a much longer answer than the other"), ("user", "ok"), ("assistant", "bye")],
        2: [("system", "be brief"), ("user", "hello there"), ("assistant", "short")],
    }
    rows = [(c, i, r, t) for c, own in turns.items() for i, (r, t) in enumerate(own)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    (got,) = [r for r in chats.preferences(frame).collect() if r.chosen is not None and r.rejected is not None]
    assert (got.chosen_id, got.rejected_id, got.n_common) == (1, 2, 2)
    written = lambda own: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)
    assert got.prompt == written(turns[1][:2])
    for side, c in ((got.chosen, 1), (got.rejected, 2)):
        text = "".join(s.text for s in side)
        assert text == written(turns[c][2:])
        learnt = "".join(s.text for s in side if s.train)
        assert learnt == "".join(f"{t}<|im_end|>\n" for r, t in turns[c][2:] if r == "assistant")


def test_texts_of_a_megabyte(spark):
    text = " ".join(f"w{i * 7919 % 1000003}" for i in range(180_000))
    rows = spark.createDataFrame([(1, text, "s", 1), (2, "x" * 1_200_000, "s", 1), (3, text[:4000], "s", 1)], "doc_id long, text string, source string, n int")
    counts = {r.doc_id: r.n_words for r in rules.statistics(rows, ["n_words", "n_repeat_words"]).collect()}
    assert counts == {1: 180_000, 2: 1, 3: len(text[:4000].split())}
    assert {r.doc_id for r in rules.keep(rows).collect()} == {1, 3}
    got = {r.doc_id: r.taken for r in mixing.mix(rows).collect()}
    assert abs(sum(got.values()) - 1.5 * (180_001 + counts[3])) <= 1
    known = spark.createDataFrame(list(licences.KNOWN), "licence string, text string")
    assert licences.scan(rows.select("doc_id", "text"), known).count() == 3
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score_quality(rows, labels).count() == 3
