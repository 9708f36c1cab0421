"""The pipeline against brute force where doc_ids are null or stand for several texts."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from planlab.llm import mixing, rules
from tests.llm.test_operators import ITEM, WORD, ordered, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    draw = random.Random(11)
    words = "the of and to a in is that it was for on with as his they at be this from have or by one had not but what all were when".split()
    words += [f"{a}{b}" for a in ("stone", "river", "field", "cloud", "paper", "glass") for b in ("work", "side", "yard", "mill", "ways", "bank", "fall", "gate")]
    made = lambda n: ". ".join(" ".join(draw.choice(words) for _ in range(12)).capitalize() for _ in range(n)) + "."
    base, passage = [made(12) for _ in range(12)], made(3)
    edited = base[0].replace("stonework", "stoneyard", 1) + " And more."
    # unique and copied texts without an id; several texts under one id; rows that repeat
    texts = [(1, base[0]), (None, base[1]), (None, edited), (None, base[2]), (None, base[3]), (2, base[4]), (2, base[5]), (2, base[1] + " End."),
             (3, base[6] + " " + passage), (None, base[7] + " " + passage), (4, base[8]), (4, base[9] + " " + passage), (5, base[10]), (5, base[10]),
             (None, base[11]), (None, base[11]), (6, made(6) + " " + ITEM), (6, made(12)), (None, made(8) + " " + ITEM)]
    return [(i, t, "en", f"s{len(t) % 2}" if len(t) % 3 else None, len(t)) for i, t in texts]  # rows that repeat agree in all columns


def _unique(docs):
    rows = ordered(docs)
    sets = [shingles(t) for (_, t), _ in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return Counter(pair for i, (pair, _) in enumerate(rows) if top[i] == i)


def _cut(docs):
    seen, out = set(), Counter()
    for (doc_id, text), copies in ordered(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        kept = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text
        if kept or not any(gone):
            out[doc_id, kept] += copies
    return out


def _pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


def test_near_duplicates_are_dropped_row_by_row(spark, docs):
    got = _pairs(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert got == _unique(docs) and sum(i is None for i, _ in got) >= 5


def test_passages_are_cut_row_by_row(spark, docs):
    out = corpus_pipeline.substring_dedup(spark, docs, "")
    assert _pairs(out) == _cut(docs) and out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = rules.keep(docs)
    source = {(r.doc_id, r.text): r for r in kept.collect()}
    unique = spark.createDataFrame([source[p] for p in _unique(kept)], SCHEMA)
    of = {}
    for r in unique.collect():  # every text of this fixture has words of its own, so its cut names it
        of[r.doc_id, r.text.split()[0:15].__str__()] = r
    want = []
    for (doc_id, text), n in _cut(unique).items():
        if len(shingles(ITEM) & shingles(text)) * 100 < 80 * len(shingles(ITEM)):
            r = of[doc_id, text.split()[0:15].__str__()]
            want += [(doc_id, text, r.lang, r.source, len(text))] * n
    assert len(want) >= 8 and sum(w[0] is None for w in want) >= 3
    mixed = mixing.mix(spark.createDataFrame(want, SCHEMA)).where("taken > 0")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, got.collect())) == Counter(map(str, mixed.select(*got.columns).collect()))
