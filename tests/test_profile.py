"""Derived literals against numpy, with brackets cut down over several rounds and sketches that are far off."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlab.operators import profile
from planlab.operators import relational as R

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.97, 0.99, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    out = []
    for i in range(4000):
        out.append((
            draw.gauss(0, 1e6), float(draw.randint(0, 3)), draw.choice([None, float("nan"), 5.0, draw.random()]), 7, i,
            draw.choices(["a", "b", "c", None, f"rare{i}"], [50, 30, 3, 5, 12])[0],
            datetime(2020, 1, 1) + timedelta(seconds=draw.randrange(10**8)),
        ))
    return out, spark.createDataFrame(
        [(*r[:6], r[6]) for r in out], "wide double, ties double, gaps double, one int, id long, word string, at timestamp_ntz"
    ).repartition(6).cache()


@pytest.mark.parametrize("few,accuracy", [(200_000, 10_000), (50, 10_000), (50, 40), (1, 10_000)])
def test_quantiles(rows, monkeypatch, few, accuracy):
    monkeypatch.setattr(profile, "FEW", few)
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    data, df = rows
    columns = ["wide", "ties", "gaps", "one", "id"]
    got = {(r.field, r.selectivity): r.literal for r in profile.quantile_literals(df, columns, QS).collect()}
    assert len(got) == len(columns) * len(QS)
    for i, c in enumerate(columns):
        values = [r[i] for r in data if r[i] is not None and r[i] == r[i]]
        for q in QS:
            assert got[c, q] == pytest.approx(np.quantile(values, q), rel=1e-12), (c, q)


def test_no_scan_shuffles_the_column(rows):
    """A sketch proposes, a scan counts: after that a few rows are left of the four thousand."""
    _, df = rows
    values = {"wide": F.col("wide")}
    bracket = profile._Bracket("wide", -np.inf, np.inf, 0, 4000, [0.5])
    (new,) = profile._narrowed(df, values, {"wide": 4000}, [bracket])
    assert new.inside <= 8 and new.below <= 1999 < 2000 < new.below + new.inside


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert profile.quantile_literals(df, ["a", "b"]).count() == 0
    assert profile.heavy_literals(df.selectExpr("CAST(a AS STRING) AS a").limit(0), ["a"]).count() == 0


def test_heavy_literals(rows):
    data, df = rows
    counts = Counter(r[5] for r in data)
    for least in (0.01, 0.1, 0.4):
        got = {(r.field, r.literal): (r.n, r.selectivity) for r in profile.heavy_literals(df, ["word", "one"], least).collect()}
        want = {("word", w): (n, n / 4000) for w, n in counts.items() if w is not None and n >= least * 4000}
        assert got == want | {("one", "7"): (4000, 1.0)}
    with pytest.raises(ValueError):
        profile.heavy_literals(df, ["word"], 1e-5)


def test_catalogue_becomes_predicates(rows):
    data, df = rows
    found = profile.predicates(profile.literal_catalogue(df, "rows", ["wide", "at", "word"]))
    assert [(p.column, p.op) for p in found].count(("word", "==")) == 3 and len(found) == 9
    days = sorted(p.literal for p in found if p.column == "at")
    micros = [(r[6] - datetime(1970, 1, 1)) / timedelta(microseconds=1) for r in data]
    assert days == [date(1970, 1, 1) + timedelta(microseconds=float(np.quantile(micros, q))) for q in (0.25, 0.5, 0.75)]
    measured = {r.predicate: r.rows_out for r in R.predicate_catalogue(df, found).collect()}
    for p in found:
        if p.column == "wide":
            assert measured[p.name] == sum(r[0] <= p.literal for r in data)
        elif p.column == "word":
            assert measured[p.name] == sum(r[5] == p.literal for r in data)
        else:
            assert measured[p.name] == sum(r[6] <= datetime(p.literal.year, p.literal.month, p.literal.day) for r in data)


def test_contained_words(spark, monkeypatch):
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 9))) for _ in range(150)} | {"a", "ab", "aba", "abab" * 20, "b" + "abab" * 20 + "c", "%", "a.b", "Z", "zz", "\u00e9" * 70}
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    want = {(o, p) for o in words for p in words if p in o}
    for head in (64, 3):
        monkeypatch.setattr(profile, "HEAD", head)
        got = [tuple(r) for r in profile.contained(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_long_word_gives_a_row_per_character(spark):
    """A word of 20,000 letters beside a few short ones."""
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    words = [long, long[5000:9000], "abc", "a", "hgfedcbahgfedcba"]
    got = {tuple(r) for r in profile.contained(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(o, p) for o in words for p in words if p in o}
