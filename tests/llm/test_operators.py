"""Operators against brute force on a small table with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlab.llm import chats, language, leaks, licences, mixing, near, quality, rules, substrings, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "what is the largest river that flows into the northern sea of this land"


def _texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "é"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(60, 160))) for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(50))
    edited = base[0].split()
    edited[7] = "changed"
    out = base + [base[1], " ".join(edited), base[2] + " " + passage, passage + " " + base[3], base[4] + " " + ITEM]
    return out + ["same " * 90, "a b " * 45, "", None, "one two", " \t\n", "line one\nline one\n" * 30, base[1] + "\x0b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(_texts())]
    rows += [(3, _texts()[3], "s0", 1), (5, "another text under the same id " * 9, "s1", 2), (None, _texts()[1], "s0", 3), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(3).cache()


def ordered(docs):
    """Distinct (doc_id, text) pairs in the operators' order, with how often each occurs."""
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    digest = lambda t: hashlib.sha256((("t" + t) if t is not None else "").encode()).hexdigest()
    return sorted(rows.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, digest(x[0][1])))


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_substrings(docs):
    seen, want = set(), Counter()
    for (doc_id, text), copies in ordered(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[doc_id, len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()] += copies
    got = substrings.remove_repeats(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got.collect()) == want


def test_near_duplicates(docs):
    rows = ordered(docs)
    sets = [shingles(t) for (_, t), _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = Counter()
    for i, ((doc_id, _), copies) in enumerate(rows):
        want[doc_id, len(sets[i]), rows[top(i)][0][0], top(i) == i] += copies
    got = near.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_signature_limit_covers_every_distance():
    most, chunks = near.limits(0.85)
    assert chunks[0][0] == 0 and chunks[-1][1] == near.SIZE and most + 1 == 2 * len(chunks)


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, _texts()[6])], "item_id long, text string")
    want = Counter()
    for r in docs.collect():
        for item, text in ((1, ITEM), (4, _texts()[6])):
            shared = len(shingles(text) & shingles(r.text))
            if 100 * shared >= 80 * len(shingles(text)):
                want[r.doc_id, item, shared, len(shingles(text))] += 1
    assert Counter(tuple(r) for r in leaks.leaks(docs, items).collect()) == want and len(want) == 2
    left = leaks.without_leaks(docs, items)
    assert left.count() == docs.count() - 2 and left.columns == docs.columns


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    total = sum(r["size"] for r in rows)
    taken, sizes, targets = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        sizes[r.source] += r["size"]
        targets[r.source] = r.target
    assert len(rows) == docs.count() and abs(sum(targets.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - t) <= 1 and t <= 2 * sizes[s] + 1e-6 for s, t in targets.items())


def test_quality_rules(docs):
    def base(text):
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in rules.statistics(docs.select("doc_id", "text").withColumn("text", F.col("text")), names).collect():
        assert tuple(r[n] for n in names) == base(r.text)


def test_rule_order_changes_no_verdict(docs):
    every = rules.BASE + rules.MORE
    one = rules.keep(docs, every).count()
    assert one == rules.keep(docs, tuple(reversed(every)), sample_rows=1).count() and one > 10
    assert rules.keep(docs).columns == docs.columns


def test_language_scores(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(r.doc_id, WORD.findall((r.text or "").translate(LOW)) + [None]) for r in docs.collect()]
    c = Counter(t for i, w in tokens if not held(i) for t in w)
    n, v = sum(c.values()), len(c)
    want = Counter((str(i), held(i), len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w), 6)) for i, w in tokens)
    got = language.score_texts(docs, rounds=2).collect()
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_quality_scores_separate_classes(spark):
    draw = random.Random(3)
    good = [" ".join(draw.choice(["river", "hill", "of", "the", "walks"]) + str(draw.randint(0, 99)) for _ in range(80)) for _ in range(60)]
    bad = ["*** " .join(["spam"] * draw.randint(40, 90)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (None, "")]
    labels = spark.createDataFrame([(i, int(i < 60), 9) for i in range(120)], "doc_id long, quality int, text int")
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 60) for r in got if r.doc_id is not None and r.doc_id < 120)


def test_urls_and_the_way_beyond_few_rules(spark):
    pages = ["http://a.example.com/en/x?q", "https://WWW.Example.com/en/", "http://example.com", "x", None, "http://b.net/fr/1#t", "http://cnet/fr/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(pages)], "page_id long, url string, rule string")
    table = spark.createDataFrame(list(urls.RULES) + [("block", None)], "verdict string, rule string")
    want = {0: "example.com/en/", 1: "www.example.com/en/", 2: None, 3: None, 4: None, 5: "net/fr/", 6: None}
    for most in (100, 0):
        got = urls.filter_urls(df, table, rule_rows=most).collect()
        assert {r.page_id: r.rule for r in got} == want and len(got) == len(pages)
        assert {r.page_id for r in got if r.verdict == "block"} == {0, 5}


def test_licences(spark):
    rows = [(1, "RELEASED under the MIT Licence"), (2, "x\nLicensed under CC BY 4.0.\n(c) 2020 A. B.\nrest of it"), (3, None), (4, ""), (1, "text")]
    known = spark.createDataFrame(list(licences.KNOWN), "licence string, text string")
    got = {(r.doc_id, r.licence, tuple(r.line_licences)) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {(1, "MIT", ("MIT",)), (2, None, ("CC-BY-4.0",)), (3, None, ()), (4, None, ()), (1, None, ())}


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "long answer"), (2, 0, "user", "hi"), (2, 1, "assistant", "short"),
             (3, 0, "user", "alone"), (3, 1, "assistant", None), (None, 0, "user", "hi"), (4, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in chats.preferences(df).collect()}
    assert set(got) == {1, 3, 4} and got[1].rejected_id == 2 and got[1].n_common == 1
    assert [s.text for s in got[1].chosen if s.train] == ["long answer<|im_end|>\n"]
    assert [s.text for s in got[1].rejected if s.train] == ["short<|im_end|>\n"]
    assert got[3].rejected is None and got[3].n_common == 1 and got[1].prompt == got[1].prompt


@pytest.mark.parametrize("run", [near.near_duplicates, substrings.remove_repeats, mixing.mix, rules.keep, language.score_texts])
def test_empty_table(spark, run):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert run(empty).count() == 0
