"""Words and texts made to collide under polynomial hashes, and very long words and texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from planlab.llm import near, substrings
from planlab.llm.tokens import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def doubled(a, b, times):
    """The sequence of ``a`` and ``b`` whose polynomial modulo 2**64 equals that of its mirror image."""
    x, y = [a], [b]
    for _ in range(times):
        x, y = x + y, y + x
    return x, y


def hashes(text, **how):
    return next(pieces(pa.array([text]))).hashes(**how)


@pytest.mark.parametrize("times", [10, 12])
def test_words_of_a_structure_differ(times):
    x, y = ("".join(s) for s in doubled("a", "b", times))
    assert len(x) == 2**times and x != y
    for seed in (0, 5):
        one, two = hashes(f"{x} {y}", seed=seed)
        assert one != two


def test_hash_is_a_function_of_the_word():
    draw = random.Random(1)
    words = ["".join(draw.choice("abAB0é") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 66, 300) for _ in range(40)]
    for lower in (False, True):
        seen = {}
        for text in (" ".join(words), "x\n" + "\t ".join(reversed(words)) + " y"):
            for word, h in zip(WORD.findall(text), hashes(text, lower=lower).tolist()):
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in word) if lower else word
                assert seen.setdefault(low, h) == h
        assert len(set(seen.values())) == len(seen)
    assert not set(hashes("a b c").tolist()) & set(hashes("a b c", seed=1).tolist())
    assert not np.any(hashes("a b c") == hashes("a b c", seed=1))


def repeats(texts, width=20):
    """Words removed from every text, by definition."""
    seen, out = set(), []
    for text in texts:
        w = WORD.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append(sum(gone))
    return out


def test_removal_and_links_of_structured_words(spark):
    pairs = [["".join(s) for s in doubled("a", "b", n)] for n in (10, 12)]
    filler = [f"w{i}" for i in range(25)]
    texts = [" ".join([*filler[:12], word, *filler[12:]]) for pair in pairs for word in pair]
    texts += [" ".join(s) for s in doubled("left", "right", 10)]  # texts as wholes
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, texts=False).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts)
    short = spark.createDataFrame([(i, f"one two {w} three four") for i, pair in enumerate(pairs) for w in pair], "doc_id long, text string")
    rows = [(2 * i + j, f"one two {w} three four") for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    got = near.near_duplicates(spark.createDataFrame(rows, short.schema), percent=85).collect()
    assert len({r.component_id for r in got}) == 4


def test_texts_of_a_megabyte(spark):
    draw = random.Random(4)
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"v{draw.randrange(10**5)}" for _ in range(150_000))
    texts = [long, long[: len(long) // 2] + " " + passage, "x" * 1_000_000 + " " + passage, long + " end", passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, texts=False).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, percent=85).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 2}  # the long word is in one shingle of 57
