"""Phrase collocation mining over sorted count streams (operator 13).

Everything is counted in one stream of windows of four words, one for every position of the corpus, laid out as an
external language-model estimator lays out its counts. In prefix order (sorted by first, second, third, fourth word)
the occurrences of a phrase of two, three or four words are one run of the stream, so one pass over a sorted partition counts
all three orders at once and lets only frequent phrases, and the runs at the ends of the partition, go on. The counted orders
are then merge-joined in lockstep: an order with the next shorter one in prefix order gives the left counts of all cuts, in
suffix order the right counts, and the next longer order, summed up in both orders, the extension counts.

Words are numbers in these streams. A task codes its texts in blocks against the words of the block; Spark adds up the
words of all blocks, numbers the frequent ones in (lang, word) order, and the numbers go back to the blocks that hold
them. A phrase with a rare word is rare, so windows end before rare words. Counts are sums of integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.llm.common import parts_of, table, union
from planlab.llm.pipeline import written

LEAST = 30  # occurrences of a candidate
TOP = 2000  # phrases returned for each lang
COVERED = 80  # percent of a phrase's occurrences inside a longer candidate at which the phrase is dropped
SCALE = 2_000_000
LONGEST = 4  # words of a window
BLOCK_BYTES = 8 << 20
HELD_BYTES = 24 << 20  # texts of all langs that a task holds at once
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


def _packed(x: np.ndarray) -> bytes:
    raw = x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()  # equal bytes of all numbers side by side
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def coded(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a text, how often each occurs, and the text as places of its words plus one, 0 between pieces."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    cut = _CUT[raw]
    inside = ~(cut | _BLANK[raw])
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    words = words.dictionary_encode()
    places = words.indices.to_numpy().astype(np.int32)
    cuts = np.cumsum(cut, dtype=np.int32)[starts]
    fresh = np.flatnonzero(np.diff(cuts, prepend=-1)) if len(cuts) else np.zeros(0, dtype=np.int64)
    counts = np.bincount(places, minlength=len(words.dictionary))
    return words.dictionary, counts, np.insert(places + 1, fresh, 0)


BLOCK = "block long, lang string, words array<binary>, n array<long>, codes binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task by lang, in blocks of some megabytes and of at least one text."""
    first = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    made = 0

    def block(lang: str) -> pa.RecordBatch:
        nonlocal made
        words, n, codes = coded(b"\n".join(held.pop(lang)))
        size.pop(lang)
        made += 1
        columns = [
            pa.array([first + made]), pa.array([lang], pa.string()),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())),
            pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())),
            pa.array([_packed(codes)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
            lang, text = lang.as_py(), text.as_py() or b""
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 100
            if size[lang] >= BLOCK_BYTES:
                yield block(lang)
            elif sum(size.values()) >= HELD_BYTES:
                yield block(max(size, key=size.get))
    for lang in list(held):
        yield block(lang)


WINDOWS = "w1 long, w2 long, w3 long, w4 long, n long"
NAMES = [f"w{i}" for i in range(1, LONGEST + 1)]


def _windows(block: pa.Table, numbers: pa.Table) -> pa.Table:
    """Distinct windows of a block with their counts: the numbers of up to four words from each position on where
    two frequent words at least follow each other, 0 from the end of the piece or the first rare word on."""
    codes = _unpacked(block.column("codes")[0].as_py())
    place = numbers.column("place").to_numpy()
    names = np.concatenate([[0], numbers.column("id").to_numpy()])  # by rank among the block's frequent words
    rank = np.zeros(int(max(codes.max(initial=0), place.max(initial=0))) + 1, dtype=np.int64)
    rank[place] = np.arange(1, len(names))
    seq = np.concatenate([rank[codes], np.zeros(LONGEST, dtype=np.int64)])
    del codes, rank
    pair = np.where((seq[:-1] > 0) & (seq[1:] > 0), seq[:-1] * len(names) + seq[1:], 0)
    kinds, pair = np.unique(pair, return_inverse=True)  # the zeros at the end make 0 the number of no pair
    begin = np.flatnonzero(pair)
    then = np.where(pair[begin + 1] > 0, pair[begin + 2], 0)  # the second pair, if the words between are frequent
    third = np.where(pair[begin + 1] > 0, seq[begin + 2], 0)
    then = np.where(then > 0, then, -third)  # three words: the third, negative; two: 0
    key = pair[begin] * (len(kinds) + len(names)) + then + len(names)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    begin, then, third = begin[at], then[at], third[at]
    columns = [names[seq[begin]], names[seq[begin + 1]], names[third], names[np.where(then > 0, seq[begin + 3], 0)], n]
    return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=[*NAMES, "n"])


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of two, three and four words in a stream of windows in prefix order: those of at least
    ``least``, and the first and the last one of every order, which may go on in the next partition."""
    open_: dict[int, list] = {}  # order -> words, count, whether the run is the first

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = np.concatenate(rows, axis=1) if rows else np.zeros((LONGEST + 1, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*NAMES, "n"])

    for batch in batches:
        columns = np.stack([batch.column(c).to_numpy() for c in [*NAMES, "n"]])
        out = []
        for order in range(2, LONGEST + 1):
            rows = columns[:, columns[order - 1] != 0]
            if not rows.shape[1]:
                continue
            words, fresh = rows[:order], np.ones(rows.shape[1], dtype=bool)
            fresh[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
            begin = np.flatnonzero(fresh)
            runs = np.zeros((LONGEST + 1, len(begin)), dtype=np.int64)
            runs[:order] = words[:, begin]
            runs[-1] = np.add.reduceat(rows[-1], begin)
            keep = runs[-1] >= least
            if order in open_ and (open_[order][0][:order] == runs[:order, 0]).all():
                runs[-1, 0] += open_[order][0][-1]
                first = open_[order][1]
            else:
                if order in open_ and (open_[order][0][-1] >= least or open_[order][1]):
                    out.append(open_[order][0][:, None])
                first = order not in open_
            keep[0] = runs[-1, 0] >= least or first
            open_[order] = [runs[:, -1].copy(), first and len(begin) == 1]
            keep[-1] = False
            out.append(runs[:, keep])
        yield batch_of(out)
    yield batch_of([x[0][:, None] for x in open_.values()])


def _words(blocks: DataFrame) -> DataFrame:
    """The words of every block: ``block, lang, place`` (from 1), ``word, n``."""
    found = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("place", "w"))
    return found.select("block", "lang", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.n").alias("n"))


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``lang, word, n, id``; frequent phrases ``w1 .. w4, n`` (0 after the last word);
    and ``lang, words``, all word occurrences."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_blocks, BLOCK), "blocks", "zstd")
    totals = blocks.select("lang", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.groupBy("lang").agg(F.sum("n").alias("words"))
    words = _words(blocks).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = written(words.orderBy("lang", "word").withColumn("id", F.monotonically_increasing_id() + 1), "words", "zstd")
    numbers = _words(blocks).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("owner"), "place", "id")
    texts = blocks.select("block", "codes").groupBy("block").cogroup(numbers.groupBy("owner"))
    windows = written(texts.applyInArrow(_windows, WINDOWS), "windows", "zstd")
    ordered = windows.repartitionByRange(parts_of(spark), *NAMES).sortWithinPartitions(*NAMES)
    runs = ordered.mapInArrow(lambda x: _runs(x, least), WINDOWS).groupBy(*NAMES).agg(F.sum("n").alias("n"))
    return words, written(runs.where(F.col("n") >= least), "phrases", "zstd"), totals


def _longer(shorter: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """Phrases of ``order`` words with the counts of both sides of every cut, from the order below.

    ``lefts`` holds the counts of the first 1, 2, ... words, ``rights`` those of what follows them. Merge joins in
    prefix order (all words but the last) and in suffix order (all words but the first) with the shorter phrases.
    """
    w = NAMES[:order]
    rows = counts.where((F.col(w[-1]) != 0) & (F.lit(True) if order == LONGEST else F.col(NAMES[order]) == 0)).select(*w, "n")
    before = shorter.select(
        *[F.col(c).alias(f"p{c}") for c in w[:-1]], "lang", "phrase", F.concat("lefts", F.array("n")).alias("lefts")
    )
    after = shorter.select(
        *[F.col(c).alias(f"s{d}") for c, d in zip(w[:-1], w[1:])], "last", F.concat(F.array("n"), "rights").alias("rights")
    )
    rows = rows.join(before.hint("merge"), [F.col(c) == F.col(f"p{c}") for c in w[:-1]])
    rows = rows.join(after.hint("merge"), [F.col(c) == F.col(f"s{c}") for c in w[1:]])
    return rows.select(*w, "n", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "lefts", "rights")


def _uncovered(phrases: DataFrame, longer: DataFrame | None, order: int, percent: int) -> DataFrame:
    """Phrases without a longer candidate that holds ``percent`` of their occurrences. Extensions by one word on
    either side are enough: a phrase inside a longer one occurs at least as often, so it is a candidate as well."""
    if longer is None:
        return phrases
    w, v = NAMES[:order], NAMES[: order + 1]
    right = longer.select(*[F.col(c).alias(f"x{c}") for c in w], F.col("n").alias("most"))
    left = longer.select(*[F.col(c).alias(f"x{d}") for c, d in zip(v[1:], w)], F.col("n").alias("most"))
    most = right.unionByName(left).groupBy(*[f"x{c}" for c in w]).agg(F.max("most").alias("most"))
    rows = phrases.join(most.hint("merge"), [F.col(c) == F.col(f"x{c}") for c in w], "left")
    wide = "CAST({} AS DECIMAL(38, 0))".format
    return rows.where(F.expr(f"most IS NULL OR {wide('most')} * 100 < {wide('n')} * {percent}")).select(*phrases.columns)


def best_per_lang(rows: DataFrame, top: int) -> DataFrame:
    """First ``top`` rows of each lang by score and count descending, then phrase, as ``rank``. Each lang is cut into
    shares that hand on their own first rows, in steps, so that no task orders a whole lang."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = parts_of(spark)
    while shares > 1:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        place = F.row_number().over(W.partitionBy("lang", share).orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= top).drop("rank")
        shares = isqrt(shares) if shares > 16 else 1
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return rows.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of two to four words that hold together, per lang.

    Words are runs without blank or tab in pieces that end at ``. , ; : ! ?`` and line ends, A-Z lower-cased. ``a`` is
    how often the phrase occurs inside pieces, ``l`` and ``r`` the occurrences of the two sides of the cut with the lowest
    score floor(2000000 a / (l + r)) (the leftmost of equal ones), ``n`` all words of the lang. A null lang is ``und``,
    together with rows whose lang is that word; a null text is empty; repeated rows count each. Other columns
    are not looked at; an empty table has no rows.
    """
    return scored(*counted(docs, least), top, covered)


def scored(words: DataFrame, counts: DataFrame, totals: DataFrame, top: int, covered: int) -> DataFrame:
    """The best phrases of each lang from what ``counted`` returns; products are decimals, so nothing overflows."""
    none = F.array().cast("array<long>")
    orders = {1: words.select(F.col("id").alias("w1"), "n", "lang", F.col("word").cast("string").alias("phrase"),
                              F.col("word").cast("string").alias("last"), none.alias("lefts"), none.alias("rights"))}
    for order in range(2, LONGEST + 1):
        orders[order] = written(_longer(orders[order - 1], counts, order), f"order{order}", "zstd")
    rows = union([
        _uncovered(orders[k], orders.get(k + 1), k, covered).select("lang", "phrase", F.col("n").alias("a"), "lefts", "rights")
        for k in range(2, LONGEST + 1)
    ])
    wide = lambda x: x.cast("decimal(20,0)")
    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda x, k: F.struct(
        F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(F.col("a")), wide(x["lefts"]) + wide(x["rights"])).alias("score"),
        k.alias("k"), x["lefts"].alias("l"), x["rights"].alias("r"),
    ))
    rows = rows.select("lang", "phrase", "a", F.array_min(cuts).alias("cut"))
    rows = rows.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
    best = best_per_lang(rows, top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op13_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations(table(spark, directory, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, words FROM (
        SELECT coalesce(lang, 'und') AS lang,
            regexp_extract_all(unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
        FROM documents
    ) WHERE len(words) > 0
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), spans AS (
    SELECT lang, words, i, unnest([1, 2, 3, 4]) AS m FROM places
), counts AS (
    SELECT lang, words[i:i + m - 1] AS p, count(*) AS f FROM spans WHERE i + m - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE len(p) > 1 AND f >= 30
), extended AS (
    SELECT lang, p, max(f) AS most FROM (
        SELECT lang, p[1:len(p) - 1] AS p, f FROM candidates UNION ALL SELECT lang, p[2:len(p)], f FROM candidates
    ) GROUP BY lang, p
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, unnest(range(1, len(c.p))) AS k
    FROM candidates c LEFT JOIN extended e ON c.lang = e.lang AND c.p = e.p
    WHERE e.most IS NULL OR 100::HUGEINT * e.most < 80::HUGEINT * c.f
), scored AS (
    SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:c.k]
        JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
    SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""
