"""Quality classifier: regularised quadratic discriminant analysis (operator 7).

Every text becomes a vector of transformed statistics. Labelled training rows give each class its
count, sums and products of statistics, added up by Spark; the model is a mean and a covariance a class,
shrunk towards its diagonal, whose Cholesky factors are computed once. A score is the logistic of the
difference of the class log densities (Mahalanobis distances and log determinants) and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import table
from planlab.llm.tokens import pieces, window_hashes
from planlab.session import checkpointed

FEATURES = 12
SHRINKAGE = 0.1
CUT = 0.3
_CLASS = np.zeros((256, 5), dtype=np.int32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[ord(c) for c in "#*$%&|<>"], 2] = 1
_CLASS[[ord(c) for c in "!?.,;:"], 3] = 1
_CLASS[10, 4] = 1


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values in each row."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[first], minlength=rows)


def _vectors(piece) -> np.ndarray:
    rows = piece.rows
    words = piece.hashes(lower=True)
    n = piece.sizes().astype(float)
    row = piece.row_of_word()
    length = (piece.ends - piece.starts).astype(float)
    letters = np.bincount(row, weights=length, minlength=rows)
    some = np.maximum(n, 1)
    chars = np.maximum(letters, 1)
    upto = np.concatenate([np.zeros((1, 5), dtype=np.int64), np.cumsum(_CLASS[piece.data], axis=0, dtype=np.int64)])
    # bytes from the first to the last word of a row
    a, b = piece.row_words[:-1], piece.row_words[1:]
    low = np.where(b > a, np.append(piece.starts, 0)[a], 0)
    high = np.where(b > a, np.append(piece.ends, 0)[np.maximum(b - 1, 0)], 0)
    counts = (upto[high] - upto[low]).astype(float)
    same = np.zeros(len(words))
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    kinds = _distinct(words, row, rows)
    grams = window_hashes(words, 3) if len(words) > 2 else np.zeros(0, dtype=np.uint64)
    inside = row[: len(grams)] == row[2:] if len(grams) else np.zeros(0, dtype=bool)
    gram_kinds = _distinct(grams[inside], row[: len(grams)][inside], rows) if len(grams) else np.zeros(rows)
    mean = letters / some
    spread = np.sqrt(np.maximum(np.bincount(row, weights=length**2, minlength=rows) / some - mean**2, 0))
    share = lambda x: np.log1p(50 * x)
    return np.stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), share(counts[:, 0] / chars), share(counts[:, 1] / chars),
            share(counts[:, 2] / chars), share(counts[:, 3] / chars), share(counts[:, 4] / some),
            share(np.bincount(row, weights=same, minlength=rows) / some), kinds / some,
            share(1 - gram_kinds / np.maximum(n - 2, 1)) * (n > 2), np.log1p(n) * kinds / some,
        ],
        axis=1,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            x = _vectors(piece)
            columns = [batch.column("doc_id").slice(piece.first, piece.rows), *[pa.array(x[:, j]) for j in range(FEATURES)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"x{j}" for j in range(FEATURES)]])


def fit(rows: DataFrame, label: str, shrinkage: float = SHRINKAGE) -> dict:
    """Class models from all rows with label 0 or 1: one aggregation of counts, sums and products.

    Returns prior, mean, Cholesky factor of the covariance and its log determinant for each class; a class
    without rows has None, and scores are then the other class's.
    """
    xs = [f"x{j}" for j in range(FEATURES)]
    sums = [F.sum(x).alias(f"s_{x}") for x in xs]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(xs) if j <= i]
    model: dict = {}
    for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        n = r["n"]
        mean = np.array([r[f"s_{x}"] for x in xs]) / n
        square = np.zeros((FEATURES, FEATURES))
        for i in range(FEATURES):
            for j in range(i + 1):
                square[i, j] = square[j, i] = r[f"p{i}_{j}"] / n
        cov = square - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + 1e-4 * np.eye(FEATURES)
        factor = np.linalg.cholesky(cov)
        model[int(r[label])] = (n, mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([batch.column(f"x{j}").to_numpy() for j in range(FEATURES)], axis=1)
        logs = {}
        for c, (n, mean, inverse, det) in model.items():
            logs[c] = np.log(n) - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * det
        if len(logs) == 2:
            score = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        else:
            score = np.full(len(x), 1.0 if 1 in logs else 0.0 if 0 in logs else 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def fold(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The model learns from labelled rows with crc32(doc_id) mod ``folds`` not 0. Null and empty texts
    have the statistics of a text without words; a null doc_id has no label and the fold of the empty
    string. Documents without a label, or with several rows of them, count as often as they are joined.
    """
    x = checkpointed(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"x{j} double" for j in range(FEATURES))))
    known = labels.select("doc_id", label).where(fold(F.col("doc_id"), folds) != 0)
    model = fit(x.join(known, "doc_id"), label)
    scored = x.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def op7_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    return score_quality(table(spark, directory, "documents"), table(spark, directory, "labels"))
