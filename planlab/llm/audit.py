"""Filter interaction audit by truth-table survival words (operator 11).

With n filters (five at most) a document that fails the set ``fails`` survives a subset of the filters when the
subset holds none of ``fails``. All 2**n answers are the bits of one 32-bit word, so the words of a part of the
corpus, counted bit by bit, say how many documents every subset lets through. Tasks count their words with carry-save
adders: three words of one weight become a sum word of that weight and a carry word of twice the weight, until two
words or less of each weight are left. Survivors of a subset are all that any order of the filters needs: the
documents kept after a step are the survivors of the filters so far.

Four filters read one text alone; the fifth (identical to the text of a smaller doc_id, table-wide) is settled by the
least doc_id of each text digest, joined back by (doc_id, digest), so a large group of copies meets in no task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import table
from planlab.llm.pipeline import written

CHUNK_BYTES = 4 << 20  # a longer text is split into words piece by piece
GROUPS = 4096  # parts whose counters a task holds before it hands them on
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"


class Text:
    """Counts of one text (UTF-8) that the filters ask for; a word is a stretch without ASCII white space."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) <= CHUNK_BYTES:
            words = data.split()
            self.words, self.distinct = len(words), len(set(words))
        else:
            known: set[bytes] = set()
            self.words, at = 0, 0
            while at < len(data):
                blank = _BLANK.search(data, at + CHUNK_BYTES)
                upto = blank.start() if blank else len(data)
                words = data[at:upto].split()
                self.words += len(words)
                known.update(words)
                at = upto
            self.distinct = len(known)

    def count(self, characters: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, characters))

    def code_points(self) -> int:
        return len(self.data) - self.count(_FOLLOWING)


def few_words(text: Text) -> bool:
    return text.words < 100


def few_kinds(text: Text) -> bool:
    return 100 * text.distinct < 80 * text.words


def capitals(text: Text) -> bool:
    return 100 * text.count(_CAPITALS) > 10 * text.code_points()


def signs(text: Text) -> bool:
    return text.count(_SIGNS) > 0


#: Failure conditions on one text by filter letter, in bit order; the letter after them is the copy filter.
FILTERS: dict[str, Callable[[Text], bool]] = {"A": few_words, "B": few_kinds, "C": capitals, "D": signs}
COPIES = "E"


def survival_words(n: int) -> np.ndarray:
    """For every set of failed filters the word whose bit s says whether subset s lets the document through."""
    fails, subset = np.meshgrid(np.arange(1 << n), np.arange(1 << n), indexing="ij")
    bits = ((fails & subset) == 0).astype(np.uint64) << subset.astype(np.uint64)
    return bits.sum(axis=1).astype(np.uint32)


class BitCounts:
    """How often each bit is set among the words added: at most two words of every weight 2**k are kept."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level = 0
        while len(words):
            if level == len(self.levels):
                self.levels.append(np.zeros(0, dtype=np.uint32))
            words = np.concatenate([self.levels[level], words])
            carries = []
            while len(words) > 2:
                third = len(words) // 3
                a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
                either = a ^ b
                carries.append((a & b) | (either & c))
                words = np.concatenate([either ^ c, rest])
            self.levels[level] = words
            words = np.concatenate(carries) if carries else words[:0]
            level += 1

    def counts(self, bits: int) -> list[int]:
        total = [0] * bits
        for level, words in enumerate(self.levels):
            for word in words.tolist():
                for bit in range(bits):
                    total[bit] += (word >> bit & 1) << level
        return total


def _judged(batches: Iterator[pa.RecordBatch], filters: dict) -> Iterator[pa.RecordBatch]:
    tests = list(filters.values())
    for batch in batches:
        fails, digests = [], []
        for data in batch.column("text").cast(pa.binary()):
            text = Text(data.as_py() or b"")
            fails.append(sum(1 << bit for bit, test in enumerate(tests) if test(text)))
            digests.append(blake2b(text.data, digest_size=16).digest())
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(fails, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "fails"])


def failures(docs: DataFrame, filters: dict[str, Callable[[Text], bool]] | None = None) -> DataFrame:
    """``doc_id, part, fails`` of every row: the set of failed filters as bits, the copy filter's bit last.

    ``part`` is lang, the empty string for null. A null text is the empty text. A row is a copy when a smaller
    doc_id holds the same text; a null doc_id counts as greater than all others, and rows that repeat the least
    doc_id of a text are all firsts. Columns other than doc_id, text and lang are not looked at.
    """
    filters = FILTERS if filters is None else filters
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    judged = rows.mapInArrow(lambda x: _judged(x, filters), "doc_id long, part string, digest binary, fails int")
    judged = written(judged, "judged")
    firsts = judged.groupBy(F.col("digest").alias("text_digest")).agg(F.min("doc_id").alias("first_id"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("text_digest"))
    copy = F.when(F.col("text_digest").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    return judged.join(firsts, same, "left").select("doc_id", "part", (F.col("fails") + copy).alias("fails"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: does a label row of the doc_id say quality 1, toxic 1. Several label rows
    of a doc_id count once, null labels as 0, and a null doc_id has no label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    flags = [F.coalesce(f"is_{x}", F.lit(0)).alias(x) for x in ("good", "toxic")]
    with_id = rows.where(F.col("doc_id").isNotNull()).join(known, F.col("doc_id") == F.col("label_id"), "left")
    without = rows.where(F.col("doc_id").isNull())  # apart, as they would all meet in one task of the join
    zero = [F.lit(0).alias(x) for x in ("good", "toxic")]
    return with_id.select(*rows.columns, *flags).unionByName(without.select(*rows.columns, *zero))


SURVIVORS = "part string, good int, toxic int, subset int, n long"


def _popcounts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = survival_words(n)
    held: dict[tuple, BitCounts] = {}

    def rows() -> pa.RecordBatch:
        out = [(*key, s, x) for key, counts in held.items() for s, x in enumerate(counts.counts(1 << n))]
        names = [x.split()[0] for x in SURVIVORS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        part = batch.column("part").dictionary_encode()
        kind = 2 * batch.column("good").to_numpy() + batch.column("toxic").to_numpy()
        group = part.indices.to_numpy().astype(np.int64) * 4 + kind
        order = np.argsort(group, kind="stable")
        found, begins = np.unique(group[order], return_index=True)
        for key, own in zip(found.tolist(), np.split(batch.column("fails").to_numpy()[order], begins[1:])):
            name = part.dictionary[key // 4].as_py(), key % 4 // 2, key % 2
            held.setdefault(name, BitCounts()).add(words[own])
        if len(held) > GROUPS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def survivors(rows: DataFrame, n: int) -> DataFrame:
    """``part, subset, kept, good, toxic``: documents that every subset of the ``n`` filters lets through, all subsets
    of every part, from rows ``part, good, toxic, fails``."""
    counted = rows.select("part", "good", "toxic", "fails").mapInArrow(lambda x: _popcounts(x, n), SURVIVORS)
    return counted.groupBy("part", "subset").agg(
        F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _steps(batches: Iterator[pa.RecordBatch], letters: str) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STEPS.split(", ")]
    everything = (1 << len(letters)) - 1
    orders = list(permutations(range(len(letters))))
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            kept, good, toxic = ({c["subset"]: c[x] for c in cells} for x in ("kept", "good", "toxic"))
            shapley, rows = dict.fromkeys(range(len(letters)), 0), []
            for order in orders:
                before = 0
                for step, f in enumerate(order, 1):
                    after = before | 1 << f
                    removed = kept[before] - kept[after]
                    shapley[f] += removed
                    fails = kept[0] - kept[1 << f]
                    alone = kept[everything & ~(1 << f)] - kept[everything]
                    name = "".join(letters[x] for x in order)
                    rows.append((f, part, name, step, kept[after], removed, fails - removed, alone, good[before] - good[after], toxic[before] - toxic[after]))
                    before = after
            columns = list(zip(*[(*row[1:], shapley[row[0]]) for row in rows]))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the subset survivors of ``survivors``."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "kept", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(lambda x: _steps(x, letters), STEPS)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Text], bool]] | None = None) -> DataFrame:
    """What each filter removes at each step of every order, per part (``failures`` and ``labelled`` say how nulls and
    repeated rows count). ``filters`` has four entries at most, as the word has 32 bits. An empty table has no rows."""
    filters = FILTERS if filters is None else filters
    if len(filters) > 4:
        raise ValueError("a survival word has room for four filters and the copy filter")
    rows = labelled(failures(docs, filters), labels)
    return orders(survivors(rows, len(filters) + 1), "".join(filters) + COPIES)


def op11_filter_audit(spark: SparkSession, directory: str) -> DataFrame:
    return audit(table(spark, directory, "documents"), table(spark, directory, "labels"))


OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
), failed AS (
    SELECT doc_id, part,
        (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL), false)::INT AS fails
    FROM worded
), known AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), steps AS (
    SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order,
        unnest([1, 2, 3, 4, 5]) AS step, unnest([v.bit, w.bit, x.bit, y.bit, z.bit]) AS bit,
        unnest([0, v.bit, v.bit + w.bit, v.bit + w.bit + x.bit, 31 - z.bit]) AS earlier
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), counted AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (fails & (earlier | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails & earlier = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails & earlier > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (fails & earlier = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (fails & earlier = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
