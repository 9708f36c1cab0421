"""MinHash near-duplicates by a multi-index Hamming join (operator 8).

Each distinct shingle set gets a signature of SIZE minima, BITS bits each. Sets of Jaccard similarity
s differ in a binomial number of positions with mean SIZE * (1 - s); the distance limit lies SIGMAS
standard deviations above the mean at the threshold. The signature is cut into chunks so that limit + 1 =
2 * chunks: by the pigeonhole principle two signatures within the limit agree on some chunk but for one
position, so a row enumerates, for every chunk, the chunk without each one position. Equal keys then hold every pair
within the limit. Candidates are compared on their full sets.

No bucket is expanded into pairs. Its members are compared with one of them first, the one that
meets most others over all buckets, and sets linked that way form components. Members of one bucket
that are still in different components are paired only if they can be links at all: by their sizes, by the
number of their shingles that any other open set holds, and by a common shingle among their rarest ones. In
a group of edited copies, a copy too far from the original is far from all others, and this shows it
without comparing it with each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.llm.common import broadcast_rows, joined_back, keyed, table, unkeyed
from planlab.llm.components import components
from planlab.llm.tokens import U, mix64, pieces, shingle_sets
from planlab.session import checkpointed

SIZE = 64
SIGMAS = 4.7
WIDTH = 5


def limits(threshold: float, size: int = SIZE) -> tuple[int, list[tuple[int, int]]]:
    """Greatest signature distance searched, and the chunks (first, end) with one error each."""
    p = 1.0 - threshold
    distance = size * p + SIGMAS * math.sqrt(size * p * (1 - p))
    chunks = min(size // 2, math.ceil((distance + 1) / 2))
    cuts = [size * i // chunks for i in range(chunks + 1)]
    return 2 * chunks - 1, list(zip(cuts[:-1], cuts[1:]))


_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 2**63, SIZE, dtype=np.uint64) | U(1)
_SHIFTS = _random.integers(0, 2**63, SIZE, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """rows x SIZE minima, 16 bits each; rows of empty sets are zero."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SIZE), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        work = np.empty_like(flat)
        for k in range(SIZE):
            np.multiply(flat, _FACTORS[k], out=work)
            np.add(work, _SHIFTS[k], out=work)
            out[full, k] = mix64(np.minimum.reduceat(work, at)) & U(0xFFFF)
    return out


def _features(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            sets = shingle_sets(piece, width)
            marks = signatures(sets)
            with np.errstate(over="ignore"):
                digests = [
                    np.array([len(s), np.bitwise_xor.reduce(s), np.add.reduce(mix64(s))], dtype=np.uint64).tobytes()
                    if len(s) else None
                    for s in sets
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").slice(piece.first, piece.rows),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ],
                names=["rid", "n_shingles", "digest", "signature"],
            )


def _keys(batches: Iterator[pa.RecordBatch], chunks: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """One row per chunk and left-out position: a hash of the other positions."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            marks = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint16)
            marks = marks.reshape(-1, SIZE).astype(np.uint64)
            columns = []
            for c, (a, b) in enumerate(chunks):
                for left_out in range(a, b):
                    key = np.full(len(marks), U(left_out * 977 + c + 1), dtype=np.uint64)
                    for j in range(a, b):
                        if j != left_out:
                            key = (key ^ marks[:, j]) * U(0x9FB21C651E98DF25)
                            key ^= key >> U(29)
                    columns.append(mix64(key))
            keys = np.stack(columns, axis=1).ravel().view(np.int64)
            per = len(columns)
            rids = np.repeat(part.column("rid").to_numpy(), per)
            sizes = np.repeat(part.column("n_shingles").to_numpy(), per)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rids), pa.array(sizes)], names=["key", "rid", "n"])


def _close(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most ``most`` positions."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SIZE) for c in ("sa", "sb"))
            near = pa.array((a != b).sum(axis=1) <= most)
            yield batch.select(["a", "b"]).filter(near)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            sets = [s.tobytes() for s in shingle_sets(piece, width)]
            rids = batch.column("rid").slice(piece.first, piece.rows)
            yield pa.RecordBatch.from_arrays([rids, pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["rid", "shingles"])


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            sets = shingle_sets(piece, width)
            rids = batch.column("rid").slice(piece.first, piece.rows).to_numpy()
            rids = np.repeat(rids, [len(s) for s in sets])
            flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(flat)], names=["rid", "shingle"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= percent * union on the full sets."""
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _verified(pairs: DataFrame, marks: DataFrame, docs: DataFrame, most: int, percent: int, width: int) -> DataFrame:
    """The pairs ``a, b`` that are links. Signatures are joined first; sets only for what they leave."""
    left = marks.select(F.col("rid").alias("a"), F.col("signature").alias("sa"))
    right = marks.select(F.col("rid").alias("b"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    near = checkpointed(near.mapInArrow(lambda it: _close(it, most), "a long, b long"))
    wanted = near.select(F.col("a").alias("rid")).unionByName(near.select(F.col("b").alias("rid"))).distinct()
    wanted = broadcast_rows(checkpointed(wanted))
    sets = docs.join(wanted, "rid", "left_semi").mapInArrow(lambda it: _sets(it, width), "rid long, shingles binary")
    sets = checkpointed(sets)
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    both = near.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return checkpointed(both.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of buckets that hold two components or more."""
    keys = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return placed.join(keys, "key")


def _prefixes(rows: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The rarest shingles of each open set that may still have a partner: ``shingle, rid, n, s, c``.

    Two sets of n and m shingles are links only if percent / (100 + percent) * (n + m) shingles are
    common. So a set of which too few shingles are held by any other open set (``s``) has no partner, and two
    links share one of their rarest shingles, as many as may be missing and one more.
    """
    least = rows.groupBy("key").agg(F.min("n").alias("n0"))
    partner = F.greatest("n0", F.ceil(percent * F.col("n") / 100))
    sets = rows.join(least, "key").groupBy("rid").agg(F.min("n").alias("n"), F.min("c").alias("c"), F.min(partner).alias("m"))
    sets = checkpointed(sets)
    every = docs.join(broadcast_rows(sets.select("rid")), "rid", "left_semi")
    every = checkpointed(every.mapInArrow(lambda it: _shingle_rows(it, width), "rid long, shingle long"))
    held = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    common = every.join(held, "shingle")
    counts = common.groupBy("rid").agg(F.count(F.lit(1)).alias("s"))
    able = sets.join(counts, "rid").where((100 + percent) * F.col("s") >= percent * (F.col("n") + F.col("m")))
    rank = F.row_number().over(W.partitionBy("rid").orderBy("held", "shingle")) + F.col("n") - F.col("s")
    missing = F.col("n") - F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    ranked = common.join(able, "rid").withColumn("rank", rank).where(F.col("rank") <= missing + 1)
    return checkpointed(ranked.select("shingle", "rid", "n", "s", "c"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Links hold where 100 * |A & B| >= percent * |A | B| for the sets of distinct lower-cased
    ``width``-word shingles. Null and empty texts have an empty set and are linked with nothing. A
    row with a null doc_id stands after all others of its component. Rows that repeat doc_id and text get the
    same result; other rows that share a doc_id are judged one by one. An empty table gives none.
    """
    base, back = keyed(docs)
    result = _judged(base, percent, width)
    kept = (F.col("rid") == F.col("__c")).alias("kept")
    if back is None:
        return result.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("__c").alias("component_id"), kept)
    names = back.select(F.col("rid").alias("__c"), F.col("doc_id").alias("component_id"))
    result = result.join(names, "__c", "left").select("rid", "n_shingles", "component_id", kept)
    return unkeyed(result, back)


def without_copies(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they came; of rows that repeat doc_id and text, one."""
    base, back = keyed(docs)
    dropped = _judged(base, percent, width).where("rid <> __c").select("rid")
    first = docs if back is None else docs.dropDuplicates(["doc_id", "text"])
    return joined_back(first, dropped, back, "left_anti")


def _judged(base: DataFrame, percent: int, width: int) -> DataFrame:
    """``rid, n_shingles, __c`` of every row of ``base`` (rid, text): the least rid of its component."""
    most, chunks = limits(percent / 100.0)
    marks = base.mapInArrow(
        lambda it: _features(it, width), "rid long, n_shingles long, digest binary, signature binary"
    )
    marks = checkpointed(marks)
    full = marks.where(F.col("digest").isNotNull())
    # equal sets are one class, represented by the least row
    classes = full.groupBy("digest").agg(F.min(F.struct("rid", "n_shingles", "signature")).alias("r"))
    classes = checkpointed(classes.select("digest", "r.*"))
    keys = classes.select("rid", "n_shingles", "signature").mapInArrow(
        lambda it: _keys(it, chunks), "key long, rid long, n long"
    )
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = checkpointed(keys.join(shared, "key"))
    # the member that meets most others leads a bucket: copies elect what they were copied from
    met = members.groupBy("rid").agg(F.sum("c").alias("met"))
    leaders = members.join(met, "rid").groupBy("key").agg(F.max(F.struct("met", -F.col("rid"))).alias("m"))
    members = checkpointed(members.join(leaders.select("key", (-F.col("m")["col2"]).alias("lead")), "key").drop("c"))
    near_size = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    sizes = classes.select(F.col("rid").alias("lead"), F.col("n_shingles").alias("nl"))
    stars = members.where("rid <> lead").select("rid", "lead", "n").distinct().join(sizes, "lead")
    stars = stars.select(F.col("lead").alias("a"), F.col("rid").alias("b"), F.col("nl").alias("na"), F.col("n").alias("nb"))
    links = _verified(stars.where(near_size).select("a", "b"), classes, base, most, percent, width)
    # members of one bucket that are still in different components
    named = components(links)
    placed = members.join(named, members["rid"] == named["node"], "left").select(
        "key", "rid", "lead", "n", F.coalesce("component", "rid").alias("c")
    )
    open_ = checkpointed(_mixed(placed).where("rid <> lead"))
    able = _prefixes(open_, base, percent, width)
    left = able.select("shingle", *[F.col(x).alias(f"{x}a") for x in ("rid", "n", "s", "c")])
    right = able.select("shingle", *[F.col(x).alias(f"{x}b") for x in ("rid", "n", "s", "c")])
    enough = (100 + percent) * F.least("sa", "sb") >= percent * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "shingle").where(F.col("ca") < F.col("cb")).where(near_size).where(enough)
    pairs = pairs.select(F.col("rida").alias("a"), F.col("ridb").alias("b")).distinct()
    links = checkpointed(links.unionByName(_verified(pairs, classes, base, most, percent, width)))
    named = components(links).withColumnRenamed("node", "rid")
    reps = classes.select("digest", "rid").join(named, "rid", "left")
    reps = reps.select("digest", F.coalesce("component", "rid").alias("__c"))
    return marks.join(reps, "digest", "left").select("rid", "n_shingles", F.coalesce("__c", "rid").alias("__c"))


def op8_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return near_duplicates(docs, percent=85)
