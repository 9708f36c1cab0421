"""Language identification by rank-order profiles (operator 12).

The n-grams of one to three characters inside the words of a text, blanks at both ends of a word included, are counted
and ranked, most frequent first. A language profile is the ranking over all training texts of the language; a text is
given the language whose profile its own ranking is least out of place with.

A character takes 21 bits, so an n-gram is one number and no hash is involved. Tasks add up the n-grams of each language and
Spark sums what they send; only PROFILE n-grams a language come to the driver. Prediction reads each text once and shuffles nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.llm.common import table

FOLDS, HELD_OUT = 4, 2
PROFILE = 400  # n-grams of a language profile
DOCUMENT = 300  # most frequent n-grams of a text that are compared
CHUNK = 1 << 19  # characters counted at once; n-grams that cross a border are counted with the chunk they begin in
HELD = 1 << 20  # n-grams a task adds up before it hands them on
UNDETERMINED = "und"
BITS = np.uint64(21)
BLANK = 32
_word_characters: list[np.ndarray] = []


def word_characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and whether it is a letter or a mark set on letters."""
    if not _word_characters:
        kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        _word_characters.extend([kinds == "L", (kinds == "L") | (kinds == "M")])
    return _word_characters[0], _word_characters[1]


def spaced(text: str) -> np.ndarray:
    """Code points of the lower-cased words of a text, one blank before, between and after; empty without a letter."""
    letter, inside = word_characters()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    if not letter[codes].any():
        return codes[:0]
    codes = np.concatenate([[BLANK], np.where(inside[codes], codes, BLANK), [BLANK]]).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    return codes[keep]


def grams(codes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """N-grams of one to three characters that begin in [begin, end) and lie inside a word and its two blanks."""
    part = codes[begin : end + 2]
    n = end - begin
    one = part[:n]
    two = (part[: len(part) - 1][:n] << BITS) | part[1:][:n]
    three = (two[: len(part) - 2] << BITS) | part[2:]
    middle = part[1:-1] != BLANK
    return np.concatenate([one[one != BLANK], two, three[middle[: len(three)]]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and how often each occurs."""
    parts = [np.unique(grams(codes, at, min(at + CHUNK, len(codes))), return_counts=True) for at in range(0, len(codes), CHUNK)]
    return summed(parts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(found)).astype(np.int64)


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            found, n = summed(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
            )

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            codes = spaced(text.as_py() or "")
            if len(codes):
                part = counted(codes)
                held.setdefault(lang.as_py(), []).append(part)
                size += len(part[0])
            if size > HELD:
                held = {k: [summed(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


def profiles(rows: DataFrame, size: int = PROFILE) -> DataFrame:
    """``lang, gram, place``: the ``size`` most frequent n-grams of each lang in ``rows`` (lang, text) that is not null,
    from place 0; equal counts in the order of the n-gram's code points. A lang without a letter has none."""
    rows = rows.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_language_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # tasks pass on their first rows only
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """Places of all profile n-grams by language, -1 where a profile lacks one: that is out of place by ``size``."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows}, key=lambda x: x.encode())
        self.grams = np.array(sorted({r["gram"] for r in rows}), dtype=np.uint64)
        self.places = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int32)
        at = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            self.places[np.searchsorted(self.grams, np.uint64(r["gram"])), at[r["lang"]]] = r["place"]

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance of n-grams, most frequent first, to every language."""
        at = np.minimum(np.searchsorted(self.grams, ranked), len(self.grams) - 1)
        known = self.grams[at] == ranked
        places = self.places[at[known]]
        out = np.where(places < 0, self.size, np.abs(places - np.flatnonzero(known)[:, None])).sum(axis=0)
        return out + self.size * int((~known).sum())

    def predict(self, text: str) -> tuple[str, float]:
        """Nearest language and by how much of the second nearest distance it is nearer."""
        codes = spaced(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        found, n = counted(codes)
        far = self.distances(found[np.argsort(-n.astype(np.int64), kind="stable")[:DOCUMENT]])
        best = int(far.argmin())
        second = np.delete(far, best).min() if len(far) > 1 else self.size * min(len(found), DOCUMENT)
        return self.langs[best], float(second - far[best]) / float(max(second, 1)) if second > far[best] else 0.0


def _predicted(batches: Iterator[pa.RecordBatch], known: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores = zip(*[known.predict(x.as_py() or "") for x in batch.column("text")]) if batch.num_rows else ((), ())
        columns = [*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def predict_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; repeated rows are predicted each.

    Profiles come from all rows with a lang whose crc32(doc_id) mod 4 is not 2 (a null doc_id counts as the empty
    string). A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    Of equally near languages the least by code point is taken, with score 0. Other columns are not looked at.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
    )
    known = Profiles(profiles(rows.where(~F.col("held_out")).select("lang", "text")).collect())  # PROFILE rows a language
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda x: _predicted(x, known), schema)


def op12_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return predict_languages(table(spark, directory, "documents"))
