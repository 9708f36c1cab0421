"""Classes of all training words: scores against a plain exchange over every word."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from planlab.llm import language
from planlab.llm.tokens import U, mix64, pieces

import pyarrow as pa

C = language.CLASSES


def _texts():
    draw = random.Random(8)
    # words that occur once or twice beside frequent ones, all with the same last two bytes
    names, verbs = [f"n{i}xx" for i in range(300)], [f"v{i}xx" for i in range(300)]
    pick = lambda pool: pool[draw.randrange(3)] if draw.random() < 0.7 else draw.choice(pool)
    return [(i, " ".join(f"{pick(names)} {pick(verbs)}" for _ in range(draw.randint(3, 12)))) for i in range(80)] + [(80, None), (None, "n1xx alone")]


def _best(own, left, right, pairs):
    """The class that makes a word's neighbours and the word itself likeliest, class by class.

    A word in class k is worth, for each neighbour, the log share of k beside that neighbour's class, and for itself
    the log of its share of k. In its own class it is weighed against the counts of the others of that class.
    """
    weight, worth = left.sum(), []
    for k in range(C - 1):
        alone = k == own
        mass = pairs[:, k].sum()
        mass = max(mass - weight, 0.5) if alone else max(mass, 1.0)
        value = -weight * math.log(mass)
        for other in range(C):
            into = max(pairs[other, k] - left[other], 0) if alone else pairs[other, k]
            value += left[other] * math.log((into + 0.5) / (pairs[other].sum() + 0.5 * C))
            out = max(pairs[k, other] - right[other], 0) if alone else pairs[k, other]
            value += right[other] * math.log((out + 0.5) / ((mass if alone else pairs[k].sum()) + 0.5 * C))
        worth.append(round(value, 9))
    return int(np.argmax(worth))


def _plain(texts, rounds):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts]
    words = [(t or "").split() for _, t in texts]
    train = [w for w, h in zip(words, held) if not h]
    c = Counter(x for w in train for x in w)
    names = sorted(c)
    hashes = next(pieces(pa.array([" ".join(names)]))).hashes(lower=True)
    with np.errstate(over="ignore"):
        kind = dict(zip(names, (mix64(hashes + U(99)) % U(C - 1)).astype(int).tolist()))
    turns = dict(zip(names, (mix64(hashes + U(7)) % U(64)).astype(int).tolist()))
    at = {x: i for i, x in enumerate(names)}

    def counts(kind):
        left, right, pairs = np.zeros((len(names), C)), np.zeros((len(names), C)), np.zeros((C, C))
        for w in train:
            k = [C - 1, *[kind[x] for x in w], C - 1]
            for i, x in enumerate(w):
                left[at[x], k[i]] += 1
                right[at[x], k[i + 2]] += 1
            for a, b in zip(k, k[1:]):
                pairs[a, b] += 1
        return left, right, pairs

    def worth(pairs):
        total, value = pairs.sum(), 0.0
        for a in range(C):
            for b in range(C):
                if pairs[a, b]:
                    value += pairs[a, b] / total * math.log(pairs[a, b] * total / pairs[a].sum() / pairs[:, b].sum())
        return value

    left, right, pairs = counts(kind)
    share = 64
    for turn in range(rounds):  # a round that makes it worse is taken back, and half as many words move
        goes = {x for x in names if (turns[x] + turn * share) % 64 < share}
        new = {x: _best(kind[x], left[at[x]], right[at[x]], pairs) if x in goes else kind[x] for x in names}
        found = counts(new)
        if worth(found[2]) < worth(pairs):
            share //= 2
        else:
            kind, (left, right, pairs) = new, found
    n, v, mass = sum(c.values()) + len(train), len(c) + 1, pairs.sum(axis=0)
    out = Counter()
    for (i, _), w in zip(texts, words):
        before, score = C - 1, 0.0
        for x in [*w, None]:
            k, m = (C - 1, len(train)) if x is None else (kind.get(x), c[x])
            p = language.MIX * (m + 1) / (n + v + 1)
            if k is not None:
                to = (pairs[before, k] + 0.1) / (pairs[before].sum() + 0.1 * C) if before is not None else (mass[k] + 0.1) / (mass.sum() + 0.1 * C)
                p += (1 - language.MIX) * to * m / max(mass[k], 1)
            score, before = score + np.log10(p), k
        out[str(i), round(float(score), 6)] += 1
    return out


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_every_training_word_has_a_class_of_its_own(spark, rounds):
    texts = _texts()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter((str(r.doc_id), round(r.score, 6)) for r in language.score_texts(df, gain=-1.0, rounds=rounds).collect())
    assert got == _plain(texts, rounds)


def test_blocks_and_groups_change_nothing(spark, monkeypatch):
    """Small blocks in groups of two."""
    texts = _texts()
    for name, value in (("BLOCK_BYTES", 300), ("LEAST_GROUP", 2), ("isqrt", lambda n: 2), ("BLOCKS_PER_BUCKET", 1)):
        monkeypatch.setattr(language, name, value)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter((str(r.doc_id), round(r.score, 6)) for r in language.score_texts(df, gain=-1.0, rounds=2).collect())
    assert got == _plain(texts, 2)


def test_exchange_goes_on_while_it_gains(spark):
    told = []
    df = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(2)
    assert language.score_texts(df, told=told).count() == len(_texts())
    rises = np.diff(told)
    assert len(told) > 2 and (rises >= 0).all() and told[-1] > told[0]


def test_blocks_are_even_without_ids():
    """Rows without an id that begin alike are dealt as they come."""
    texts = [f"one header for all of them {'word ' * (i % 50)} {i}" for i in range(3000)]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([None] * 500, pa.int64()), pa.array([False] * 500), pa.array(texts[a : a + 500])], names=["doc_id", "held_out", "text"]
    ) for a in range(0, 3000, 500)]

    class Task:
        partitionId = staticmethod(lambda: 7)

    was = language.TaskContext.get
    language.TaskContext.get, size = (lambda: Task), language.BLOCK_BYTES
    language.BLOCK_BYTES = 40_000
    try:
        rows = [len(b.column("held_out")[i].as_py()) for b in language._blocks(iter(batches)) for i in range(b.num_rows) if b.column("bucket")[i].as_py() < 0]
    finally:
        language.TaskContext.get, language.BLOCK_BYTES = was, size
    assert sum(rows) == 3000 and max(rows[:-1]) <= 2 * sorted(rows)[len(rows) // 2]


def test_texts_of_a_megabyte(spark):
    long = " ".join(f"w{i % 1000}" for i in range(200_000))
    rows = [(0, long), (1, long + " end"), (2, "w1 w2"), (5, None)]
    got = {r.doc_id: r for r in language.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    assert got[0].n_tokens == 200_001 and got[1].n_tokens == 200_002 and got[5].n_tokens == 1
    assert got[0].train_tokens == sum(got[i].n_tokens for i in got if not got[i].held_out)
