"""Mixing against the rule as it is told: sources one after the other, documents one after the other."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from planlab.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def dealt(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST_EPOCHS):
    """Targets by rounds: deal what is left by weight, stop the sources that are full, again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


def test_targets(spark):
    draw = random.Random(2)
    cases = [{"a": 10, "b": 100, "c": 100}, {"only": 7}, {None: 5, "a": 0}, {"a": 0, None: 0}, {"": 3, None: 900, "z": 1}]
    cases += [{f"s{i}": draw.choice([0, 1, 5, 50, 5000]) for i in range(n)} for n in (4, 30)]
    for sizes in cases:
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "__s string, n long")).collect()
        want = dealt(sizes)
        assert {r["__s"]: r.target for r in got} == {s: pytest.approx(t) for s, t in want.items()}
        for r in got:
            n = sizes[r["__s"]]
            assert r.epochs == (int(r.target // n) if n else 0) and r.rest == round(r.target - r.epochs * n)


def _check(docs, rows, **how):
    """Every source meets its target by whole epochs and the first documents in key order."""
    got = rows.collect()
    assert len(got) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = dealt(sizes, **how)
    assert target == {s: pytest.approx(t) for s, t in want.items()}
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    cut = defaultdict(set)
    for r in got:
        assert r.source_size == sizes[r.source]
        epochs = int(want[r.source] // sizes[r.source]) if sizes[r.source] else 0
        if r["size"] and 0 < r.taken - epochs * r["size"] < r["size"]:
            cut[r.source].add((r.doc_id, r.text))
    assert all(len(x) == 1 for x in cut.values())  # one document is cut, or copies of one
    return got


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)) + draw.choice(["", " # $", " ***"]), draw.choice(["a", "b", "b", "b", None]), i) for i in range(400)]
    rows += [(None, None, "a", 1), (None, "x y", None, 2), (7, "other text", "c", 3), (8, "", "d", 4), (9, "one two", "d", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int").repartition(5).cache()


def test_mix(docs):
    got = _check(docs, mixing.mix(docs))
    assert all(r["size"] == len(WORD.findall(r.text or "")) for r in got)
    again = mixing.mix(docs.repartition(2))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    assert again.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]


def test_key_order(spark, docs):
    """With the key rebuilt outside, the documents before the crossing are taken whole, those behind it not."""
    rows = mixing.mix(docs)
    text = F.col("text")
    unit = (F.pmod(F.xxhash64(F.xxhash64(F.col("doc_id").cast("string"), text), F.lit(mixing.SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    for source, own in _by_source(rows.withColumn("u", unit).collect()).items():
        def key(r):
            symbols = len(re.findall(r"[#*$%&|<>]", r.text or ""))
            return -math.log(r.u) * (1 + 4 * symbols / max(r["size"], 1))

        epochs = int(own[0].target // own[0].source_size) if own[0].source_size else 0
        parts = [r.taken - epochs * r["size"] for r in sorted(own, key=key) if r["size"]]
        whole = [p == r["size"] for p, r in zip(parts, sorted((r for r in own if r["size"]), key=key))]
        first = whole.index(False) if False in whole else len(whole)
        assert not any(parts[first + 1 :])


def _by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def test_copies_share_the_crossing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    copies = spark.createDataFrame([(1, "w " * 20, "a", "e")] * 6 + [(2, "v " * 40, "b", "e")], "doc_id long, text string, source string, extra string")
    for n in (1, 3):
        got = mixing.mix(copies.repartition(n), weights=(1.0, 2.0), share=0.9).collect()
        want = dealt({"a": 120, "b": 40}, (1.0, 2.0), 0.9)
        own = sorted(r.taken for r in got if r.source == "a")
        assert len(own) == 6 and abs(sum(own) - want["a"]) <= 0.5 and own[-1] - own[0] <= 1


def test_low_weights_and_one_hot_group(spark):
    """Keys that pile up (weights down to 0.02) and a third of the rows equal in every column."""
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS doc_id", "IF(id % 3 = 0, 'same words here', repeat('w # # ', CAST(id % 7 AS INT))) AS text", "'s' AS source")
    _check(rows, mixing.mix(rows, quality=F.lit(0.02)), weights=(5.0,))


def test_many_sources_and_none(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 11 AS INT)) AS text", "CONCAT('s', id % 1500) AS source")
    _check(rows, mixing.mix(rows))
    empty = mixing.mix(rows.limit(0))
    assert empty.count() == 0 and empty.columns[-1] == "taken"
    assert mixing.mix(rows.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "source")).where("taken <> 0 OR target <> 0").count() == 0
