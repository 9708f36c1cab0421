"""Filter audit against brute force over every order, and the counting of bits against plain sums."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from planlab.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "ABCDE"


def _texts():
    draw = random.Random(11)
    plain = lambda n: " ".join(f"w{draw.randrange(4000)}" for _ in range(n))
    out = [plain(n) for n in (5, 99, 100, 101, 140, 300)]
    out += ["same " * 200, ("a b c d " * 25) + plain(99), "UPPER CASE " * 60, plain(120).upper(), plain(150) + " 50%", "a|b " + plain(110)]
    out += ["", None, "\x0b\x0c \t\n", "É" * 10 + "A", "ÀÉ wörd  nbsp", "x" * 5000, out[5], out[5], out[7], "#"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, t, draw.choice(["en", "fr", "", None]), i, "x") for i, t in enumerate(_texts())]
    rows += [rows[5], (None, _texts()[5], "en", 0, "x"), (None, "only here " * 70, "en", 0, "x"), (None, "only here " * 70, None, 0, "x")]
    rows += [(40, _texts()[4], "de", 0, "x"), (40, _texts()[6], "de", 0, "x"), (-7, "", "en", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, PART int, `fails.x` string").repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 18)] + [(3, 0, 1), (5, None, None), (None, 1, 1), (40, 1, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute(docs, labels):
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in docs.collect()]
    known = labels.collect()
    good = {r.doc_id for r in known if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in known if r.toxic == 1 and r.doc_id is not None}
    judged = []
    for doc_id, text, part in rows:
        w = WORD.findall(text)
        rank = float("inf") if doc_id is None else doc_id
        earlier = any(t == text and (float("inf") if d is None else d) < rank for d, t, _ in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier}
        judged.append((part, {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        for order in permutations(LETTERS):
            for step, f in enumerate(order):
                gone = set(order[:step])
                here = [x for x in own if f in x[1] and not x[1] & gone]
                out[part, "".join(order), step + 1] = [
                    sum(1 for x in own if not x[1] & (gone | {f})), len(here), sum(1 for x in own if f in x[1] and x[1] & gone),
                    sum(1 for x in own if x[1] == {f}), sum(x[2] for x in here), sum(x[3] for x in here),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(docs, labels):
    got = audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(docs, labels)
    assert len(got) == 600 * 4


def test_tables_without_rows(spark, docs, labels):
    assert audit.audit(docs.limit(0), labels).count() == 0
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, labels.limit(0)).collect()}
    assert got == brute(docs, labels.limit(0))


def test_own_filters(spark, docs, labels):
    few = audit.audit(docs, labels, {"W": lambda t: t.words > 100})
    assert {r.filter_order for r in few.collect()} == {"WE", "EW"}
    with pytest.raises(ValueError):
        audit.audit(docs, labels, dict.fromkeys("PQRST", audit.signs))


def test_carry_save_counts():
    draw = np.random.default_rng(1)
    counts, seen = audit.BitCounts(), np.zeros(32, dtype=np.int64)
    for size in (0, 1, 2, 3, 7, 1000, 12345):
        words = draw.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
        counts.add(words)
        seen += ((words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(axis=0).astype(np.int64)
        assert counts.counts(32) == seen.tolist()
    assert all(len(x) <= 2 for x in counts.levels)


def test_very_long_text_in_chunks(monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["ab", "c", " ", "\t", "\n", "é"]) for _ in range(20000)).encode()
    whole = audit.Text(text)
    monkeypatch.setattr(audit, "CHUNK_BYTES", 64)
    cut = audit.Text(text)
    assert (cut.words, cut.distinct) == (whole.words, whole.distinct) == (len(text.split()), len(set(text.split())))


def test_many_parts_are_handed_on(spark, labels, monkeypatch):
    rows = spark.range(60).selectExpr("id AS doc_id", "repeat('w ', CAST(id AS INT)) AS text", "CAST(id % 20 AS STRING) AS lang")
    monkeypatch.setattr(audit, "GROUPS", 3)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(rows, labels).collect()}
    assert got == brute(rows, labels)
