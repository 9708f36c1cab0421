"""Collocations against plain counting, with hot words, tiny blocks and partitions that cut runs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from planlab.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for q, a in candidates.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if 100 * inside[p] >= covered * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _rows():
    draw = random.Random(7)
    kinds = ["the", "The", "of", "new", "york", "times", "é\x01", "zz", "a b", "q\x1f"]
    weights = [30, 5, 10, 8, 8, 4, 3, 3, 2, 2]
    out = []
    for i in range(300):
        words = draw.choices(kinds, weights, k=draw.randint(0, 40))
        for at in range(len(words)):
            if draw.random() < 0.1:
                words[at] += draw.choice([".", ", ", "\n", "!?", "\x0b", ":x"])
        if draw.random() < 0.4:
            words += ["in", "new", "york", "city"]
        out.append((draw.choice([" ", "\t", "  "]).join(words), draw.choice(["en", "en", "en", "fr", "und", None])))
    return out + [("the " * 5000, "en"), (None, "en"), ("", None), (". ; !", "de"), ("rare", "nl"), *[("same line here now", "en")] * 40, ("x" * 3000 + " end", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "p") for r in _rows()], "text string, lang string, w1 int, `phrase` string").repartition(5).cache()


@pytest.mark.parametrize("least,top,block", [(3, 2000, 8 << 20), (30, 5, 500), (1, 50, 3000)])
def test_against_definition(docs, monkeypatch, least, top, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    got = phrases.collocations(docs, least, top)
    assert sorted(tuple(r) for r in got.collect()) == brute(_rows(), least, top)


def test_tables_without_rows(docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("text IS NULL")).count() == 0


def test_runs_cut_anywhere():
    """The counts of a stream of windows do not depend on where partitions and batches cut it."""
    draw = np.random.default_rng(4)
    windows = Counter()
    for _ in range(3000):
        w = draw.integers(1, 4, 4)
        w[draw.integers(2, 5) :] = 0
        windows[tuple(w.tolist())] += int(draw.integers(1, 4))
    rows = sorted(windows.items())
    want = Counter()
    for w, n in rows:
        for m in range(2, 5):
            if w[m - 1]:
                want[w[:m] + (0,) * (4 - m)] += n
    for least in (1, 200):
        for _ in range(20):
            cuts = sorted(draw.integers(0, len(rows) + 1, 6).tolist())
            got = Counter()
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                part = rows[a:b]
                batches = []
                for at in range(0, len(part), 7):
                    cell = part[at : at + 7]
                    columns = [pa.array([w[i] for w, _ in cell], pa.int64()) for i in range(4)] + [pa.array([n for _, n in cell], pa.int64())]
                    batches.append(pa.RecordBatch.from_arrays(columns, names=[*phrases.NAMES, "n"]))
                for batch in phrases._runs(iter(batches), least):
                    for *w, n in zip(*[c.to_pylist() for c in batch.columns]):
                        got[tuple(w)] += n
            assert {k: v for k, v in got.items() if v >= least} == {k: v for k, v in want.items() if v >= least}


def test_scores_pass_64_bits(spark):
    """2000000 * a and the sums of both sides are worked out in decimals."""
    big = 4 * 10**18
    one = [(1, "the", big), (2, "end", big)]
    words = spark.createDataFrame([("en", w.encode(), n, i) for i, w, n in one], "lang string, word binary, n long, id long")
    counts = spark.createDataFrame([(1, 2, 0, 0, big - 1)], phrases.WINDOWS)
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, words long")
    got = phrases.scored(words, counts, totals, top=5, covered=80).collect()
    assert [tuple(r) for r in got] == [("en", 1, "the end", big - 1, big, big, 9 * 10**18, 2000000 * (big - 1) // (2 * big))]


def test_best_per_lang_in_shares(spark):
    draw = random.Random(1)
    rows = [(lang, f"p{i} {draw.randrange(9)}", draw.randrange(40), draw.randrange(6)) for lang in "xy" for i in range(800)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted((r.lang, r.rank, r.phrase) for r in phrases.best_per_lang(frame, 30).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = []
    for lang in "xy":
        own = sorted((-s, -a, p) for x, p, a, s in rows if x == lang)[:30]
        want += [(lang, i, p) for i, (_, _, p) in enumerate(own, 1)]
    assert got == sorted(want)
