"""Language profiles against plain counting, and the defined results of texts without letters."""

import zlib
from collections import Counter

import pytest

from planlab.llm import tongues

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog and then it thinks about the weather that there is",
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und denkt dann über das Wetter nach, ß",
    "el": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά σκέφτεται τον καιρό",
}


def plain_grams(text):
    """Counts of n-grams of one to three characters of blank-padded words, by definition."""
    import unicodedata

    text = text.lower()
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text).split(" ")
    counts = Counter()
    for w in filter(None, words):
        padded = f" {w} "
        for n in (1, 2, 3):
            counts.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
    # the blank between two words is shared: it is the end of one and the begin of the next
    return counts


def number(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def ranked(counts, size):
    return [g for g, _ in sorted(((number(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(60):
        lang = ["en", "de", "el"][i % 3]
        rows.append((i, " ".join(TEXTS[lang].split()[i % 4 : 9 + i % 6]), lang if i % 7 else None, "clash"))
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "12345 !? ́", "en", "x"), (103, "汉字", None, "x"), (None, TEXTS["en"], "en", "x"),
             (None, TEXTS["de"], None, "x"), (104, TEXTS["el"] * 300, "el", "x"), (1, TEXTS["de"], "de", "x"), (1, TEXTS["de"], "de", "x"), (105, "only digits 1", "de2", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, LANG_PRED string").repartition(3).cache()


def brute(docs, profile=tongues.PROFILE, most=tongues.DOCUMENT):
    rows = docs.collect()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4
    counts = {}
    for r in rows:
        if r.lang is not None and fold(r.doc_id) != 2:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text or ""))
    places = {k: {g: i for i, g in enumerate(ranked(v, profile))} for k, v in counts.items() if v}
    out = []
    for r in rows:
        own = ranked(plain_grams(r.text or ""), most)
        if not own or not any(c.isalpha() for c in r.text):
            out.append((r.doc_id, fold(r.doc_id) == 2, "und", 0.0))
            continue
        far = {k: sum(abs(i - p[g]) if g in p else profile for i, g in enumerate(own)) for k, p in places.items()}
        best = min(sorted(far, key=str.encode), key=far.get)
        second = min(v for k, v in far.items() if k != best)
        out.append((r.doc_id, fold(r.doc_id) == 2, best, (second - far[best]) / max(second, 1)))
    return out


def test_against_definition(docs):
    got = [tuple(r) for r in tongues.predict_languages(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(brute(docs), key=key)
    assert all(0 <= r[3] <= 1 for r in got)


def test_counting_in_chunks(monkeypatch):
    for text in [*TEXTS.values(), "a", " a", "ab  cd", "a-b'ćd", "x\n\ny" * 50]:
        monkeypatch.setattr(tongues, "CHUNK", 1 << 19)
        found, n = tongues.counted(tongues.spaced(text))
        assert dict(zip(found.tolist(), n.tolist())) == {number(g): c for g, c in plain_grams(text).items()}
        monkeypatch.setattr(tongues, "CHUNK", 3)
        again, m = tongues.counted(tongues.spaced(text))
        assert (again == found).all() and (m == n).all()


def test_counts_handed_on_early(docs, monkeypatch):
    whole = {tuple(r) for r in tongues.profiles(docs).collect()}
    monkeypatch.setattr(tongues, "HELD", 50)
    assert {tuple(r) for r in tongues.profiles(docs).collect()} == whole


def test_nothing_learned(docs):
    assert tongues.predict_languages(docs.limit(0)).count() == 0
    got = tongues.predict_languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == docs.count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = tongues.predict_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) > 200
