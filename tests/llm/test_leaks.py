"""Decontamination against exact containment, with short items and no rows on either side."""

import random
import re
from collections import Counter

import pytest

from planlab.llm import leaks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def windows(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, percent=80):
    own = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            own.setdefault(item, set()).update(windows(w, min(5, len(w))))
    out = Counter()
    for doc_id, text in docs:
        w = words(text)
        held = set().union(*[windows(w, n) for n in range(1, 6)])
        for item, shingles in own.items():
            both = len(shingles & held)
            if both and 100 * both >= percent * len(shingles):
                out[doc_id, item, both, len(shingles)] += 1
    return out


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(6)
    text = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 9, 15, 16, 33, 64, 200, 900])]
    items += [(50, "Blue Harvest Moon"), (51, "lonely"), (52, "two words"), (53, "w1 w2\tw3\nw4"), (54, None), (55, " \t"), (None, "nobody asks"), (0, text(7)), (50, text(12))]
    docs = []
    for i, item in enumerate(items):
        w = words(item[1])
        for share in (1.0, 0.9, 0.7):
            broken = [x if draw.random() < 0.995 or share == 1.0 else "changed" for x in w[: max(1, int(len(w) * share))]]
            docs.append((len(docs), f"{text(40)} {' '.join(broken)} {text(3000 if i % 4 == 0 else 30)}"))
    docs += [(900, "the BLUE harvest\x0bmoon rose"), (901, "blue moon harvest"), (902, "lonely"), (903, None), (904, ""), (905, "w1 w2 w3"), (None, "two words"), (None, "two words"), (902, "lonely")]
    return docs, items


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_leaks(spark, cases, bits, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", bits)
    monkeypatch.setattr(leaks, "FEWEST_BITS", 64)
    docs, items = cases
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item_id string, `h.x` int").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in leaks.leaks(frame, table).collect())
    assert got == brute(docs, items) and (900, 50) not in {x[:2] for x in got}  # item 50 has a second row
    assert {x[1] for x in got} >= {1, 51, 52, 53}


def test_three_words(spark):
    docs = spark.createDataFrame([(1, "under a blue harvest moon"), (2, "blue harvest sky")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Blue harvest moon")], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 9, 1, 1)]
    assert [r.doc_id for r in leaks.without_leaks(docs, items).collect()] == [2]


def test_no_rows_on_one_side(spark, cases):
    docs = spark.createDataFrame(cases[0], "doc_id long, text string")
    items = spark.createDataFrame(cases[1], "item_id long, text string")
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.without_leaks(docs, items.limit(0)).count() == docs.count()
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.without_leaks(docs.limit(0), items).count() == 0
    assert leaks.leaks(docs, items.where("text IS NULL")).columns == ["doc_id", "item_id", "n_shared", "n_item"]


def test_a_megabyte(spark):
    long = " ".join(f"v{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long + " one two three four five six seven"), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame([(3, "one two three four five six seven")], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 3, 3, 3)]
