"""Brown class-based n-gram scores (operator 5).

P(word | before) = (1 - MIX) * P(class(word) | class(before)) * P(word | class(word)) + MIX * P_base(word), where
P_base is the add-one unigram over all training tokens. Counts come from all training texts. A task codes its texts in blocks
of some megabytes, as they come, as numbers of the block's distinct words; tokens are never moved or grouped by word.

Classes are found by exchange, and every training word is moved on its own. Words are dealt to buckets by hash, blocks to
groups of about the square root of their number. In a round each block counts its words next to every class; the counts of a bucket are added
up by group of blocks and then over the groups, so no task gathers a row of every block. The bucket weighs its words against all
classes with the class-pair counts of the round (the word's own share taken out), moves each to the best one, and
the classes go back the same way. Only the class-pair counts, a table that the corpus does not change, come to the driver. They
also give the likelihood of the round. All words move at once at first; a round that lowers the likelihood is taken back, and from
then on half as many move, those whose turn it is by hash. The exchange goes on until a round raises the likelihood by less
than GAIN for all words. A word without training count has no class: what follows it is scored by the class frequencies alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import parts_of, table
from planlab.llm.pipeline import dropped, written
from planlab.llm.tokens import U, mix64, pieces

CLASSES = 32
GAIN = 0.01  # least rise of the mean log-likelihood of a training token (nats) for another round
MIX = 0.1
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 5 << 20
UNKNOWN = CLASSES  # class number of words without training count
END = CLASSES - 1  # class of the end alone
BLOCKS_PER_BUCKET = 16
LEAST_GROUP = 64  # blocks of a group, if there are so many
TURNS = 64  # parts of the words that take turns where not all move at once


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest one needs, equal bytes of all numbers side by side."""
    most = int(x.max(initial=0))
    wide = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    raw = x.astype(f"<u{wide}").view(np.uint8)
    raw = (raw.reshape(-1, wide).T if wide > 1 else raw).tobytes()
    return bytes([wide]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    wide, size = x[0], int.from_bytes(x[1:9], "little")
    raw = np.frombuffer(pa.decompress(x[9:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    if wide > 1:
        raw = np.ascontiguousarray(raw.reshape(wide, -1).T).view(f"<u{wide}").ravel()
    return raw.astype(np.int64)


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return _packed(np.diff(x, prepend=0))


def _walked(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x))


BLOCK = "block long, bucket int, doc_id array<bigint>, held_out array<boolean>, sizes binary, codes binary, h binary, n binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task in blocks of BLOCK_BYTES, and one more text at most."""
    block, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 64)
        first = 0
        while first < batch.num_rows:
            done = upto[first - 1] if first else 0
            last = min(int(np.searchsorted(upto, done + BLOCK_BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(first, last - first))
            size += int(upto[last - 1] - done)
            first = last
            if size >= BLOCK_BYTES:
                yield from _block(pa.Table.from_batches(held), block).to_batches()
                block, held, size = block + 1, [], 0
    if held:
        yield from _block(pa.Table.from_batches(held), block).to_batches()


def _block(data: pa.Table, block: int) -> pa.Table:
    """Texts of a block as numbers of its sorted distinct words (bucket -1), and a row of the words and their training counts."""
    sizes, words = zip(*((p.sizes(), p.hashes(lower=True)) for p in pieces(data.column("text"))))
    sizes = np.concatenate(sizes)
    words, codes = np.unique(np.concatenate(words), return_inverse=True)
    held = np.asarray(data.column("held_out").to_pylist(), dtype=bool)
    n = np.bincount(codes, weights=np.repeat(~held, sizes), minlength=len(words)).astype(np.int64)
    rows = [{"block": block, "bucket": -1, "doc_id": data.column("doc_id").to_pylist(), "held_out": held.tolist(),
             "sizes": _packed(sizes), "codes": _packed(codes)}]
    rows.append({"block": block, "bucket": 0, "h": words.tobytes(), "n": _packed(n)})
    return _table(rows, BLOCK)


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(),
             "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()),
             "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


BUCKETED = "block long, part int, bucket int, h binary, n binary"


def _bucketed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of each block by bucket."""
    for batch in batches:
        for block, part, h, n in zip(*[batch.column(x).to_pylist() for x in ("block", "part", "h", "n")]):
            words, n = np.frombuffer(h, dtype=np.uint64), _unpacked(n)
            of = (words >> U(32)) * U(buckets) >> U(32)  # ascending, as the words are
            found, firsts = np.unique(of, return_index=True)
            rows = [{"block": block, "part": part, "bucket": k, "h": words[x:y].tobytes(), "n": _packed(n[x:y])}
                    for k, x, y in zip(found.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(words)])]
            yield from _table(rows, BUCKETED).to_batches()


PARTIAL = "bucket int, part int, h binary, n binary"


def _added(own: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The union of sorted word lists, each list's places in it, and the sum of their counts."""
    words, ids = np.unique(np.concatenate(own), return_inverse=True)
    c = np.bincount(ids, weights=np.concatenate(n), minlength=len(words)).astype(np.int64)
    return words, np.split(ids, np.cumsum([len(x) for x in own])[:-1]), c


def _words_of(data: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, dtype=np.uint64) for x in data.column("h").to_pylist()], [_unpacked(x) for x in data.column("n").to_pylist()]


def _partial_words(data: pa.Table) -> pa.Table:
    """Words of a bucket in a group of blocks with their counts."""
    words, _, c = _added(*_words_of(data))
    row = {x: data.column(x)[0].as_py() for x in ("bucket", "part")}
    return _table([row | {"h": words.tobytes(), "n": _packed(c)}], PARTIAL)


GROUPS = "bucket int, part int, ids binary, c binary, class binary, turn binary, tokens long, kinds long"


def _bucket_words(data: pa.Table) -> pa.Table:
    """Words of a bucket numbered, counted over all groups and given a first class; a row per group."""
    words, ids, c = _added(*_words_of(data))
    with np.errstate(over="ignore"):
        classes = np.where(c > 0, mix64(words + U(99)) % U(CLASSES - 1), UNKNOWN).astype(np.uint8)
        turns = (mix64(words + U(7)) % U(TURNS)).astype(np.uint8)
    rows = []
    for part, at in zip(data.column("part").to_pylist(), ids):
        rows.append({"bucket": data.column("bucket")[0].as_py(), "part": part, "ids": _steps(at), "c": _packed(c[at]),
                     "class": classes[at].tobytes(), "turn": turns[at].tobytes(), "tokens": 0, "kinds": 0})
    rows[0] |= {"tokens": int(c.sum()), "kinds": int((c > 0).sum())}  # once a bucket
    return _table(rows, GROUPS)


WORDS = "block long, bucket int, part int, ids binary, c binary, class binary"


def _block_words(data: pa.Table, group: pa.Table) -> pa.Table:
    """The words of each block as places among the words of its group, with their counts and classes."""
    own, n = _words_of(data)
    _, ids, _ = _added(own, n)
    c, classes = _unpacked(group.column("c")[0].as_py()), np.frombuffer(group.column("class")[0].as_py(), dtype=np.uint8)
    rows = [{"block": b, "bucket": k, "part": p, "ids": _steps(i), "c": _packed(c[i]), "class": classes[i].tobytes()}
            for b, k, p, i in zip(*[data.column(x).to_pylist() for x in ("block", "bucket", "part")], ids)]
    return _table(rows, WORDS)


CODED = "block long, part int, doc_id array<bigint>, held_out array<boolean>, sizes binary, codes binary, c binary, bucket array<int>, ids array<binary>"


def _coded(data: pa.Table, words: pa.Table) -> pa.Table:
    """A block's row with the counts and the bucket numbers of its words."""
    words = words.sort_by("bucket")
    row = data.select(["block", "doc_id", "held_out", "sizes", "codes"]).to_pylist()[0]
    c = np.concatenate([np.zeros(0, dtype=np.int64), *[_unpacked(x) for x in words.column("c").to_pylist()]])
    row |= {"c": _packed(c), "bucket": words.column("bucket").to_pylist(), "ids": words.column("ids").to_pylist()}
    row["part"] = words.column("part")[0].as_py() if len(words) else 0
    return _table([row], CODED)


def _chain(data: pa.Table, classes: pa.Table):
    """A block's word numbers, their places in the sequence of all texts with an end each, the classes of the
    sequence and those before, the text of each place, and the classes of the block's words by bucket."""
    own = [np.frombuffer(x, dtype=np.uint8) for x in classes.sort_by("bucket").column("class").to_pylist()]
    codes, sizes = _unpacked(data.column("codes")[0].as_py()), _unpacked(data.column("sizes")[0].as_py())
    places = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
    kind = np.full(len(codes) + len(sizes), END, dtype=np.int64)
    kind[places] = np.concatenate([np.zeros(0, dtype=np.uint8), *own])[codes]
    before = np.concatenate([[END], kind[:-1]])  # a text begins after an end
    return codes, places, kind, before, sizes + 1, own


SUMS = "bucket int, part int, ids binary, at binary, n binary"


def _sums(data: pa.Table, classes: pa.Table) -> pa.Table:
    """Training counts of a block: class pairs (bucket -1) and, per bucket, its words next to each class, with the
    class before at cells 0 to CLASSES - 1 and the class after at the cells behind them."""
    codes, places, kind, before, sizes, own = _chain(data, classes)
    train = np.repeat(~np.asarray(data.column("held_out")[0].as_py(), dtype=bool), sizes)
    pairs = np.bincount((before * CLASSES + kind)[train], minlength=CLASSES * CLASSES)
    part = data.column("part")[0].as_py()
    rows = [{"bucket": -1, "part": part, "ids": _steps(np.arange(CLASSES)), "at": _steps(np.arange(len(pairs))), "n": _packed(pairs)}]
    taken = train[places]
    codes, places = codes[taken], places[taken]
    width, first = 2 * CLASSES, 0
    size = width * sum(len(x) for x in own)
    cells = np.concatenate([codes * width + before[places], codes * width + CLASSES + kind[places + 1]])
    cells = np.sort(cells.astype(np.int32) if size < 1 << 31 else cells)
    heads = np.flatnonzero(np.diff(cells, prepend=-1))
    at, counts = cells[heads].astype(np.int64), np.diff(np.append(heads, len(cells)))
    for bucket, ids, kinds in zip(data.column("bucket")[0].as_py(), data.column("ids")[0].as_py(), own):
        x, y = np.searchsorted(at, [first * width, (first + len(kinds)) * width])
        rows.append({"bucket": bucket, "part": part, "ids": ids, "at": _steps(at[x:y] - first * width), "n": _packed(counts[x:y])})
        first += len(kinds)
    return _table(rows, SUMS)


COMBINED = "bucket int, part int, at binary, n binary"


def _cells_of(data: pa.Table, ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all rows by the places their words have above, and the counts."""
    at, n = [], []
    for i, cells, counts in zip(ids, *[data.column(x).to_pylist() for x in ("at", "n")]):
        cells = _walked(cells)
        at.append(i[cells // width] * width + cells % width)
        n.append(_unpacked(counts))
    return np.concatenate(at), np.concatenate(n)


def _combined(data: pa.Table) -> pa.Table:
    """Counts of a bucket, or of the class pairs, added up over a group of blocks."""
    row = {x: data.column(x)[0].as_py() for x in ("bucket", "part")}
    at, n = _cells_of(data, [_walked(x) for x in data.column("ids").to_pylist()], CLASSES if row["bucket"] < 0 else 2 * CLASSES)
    found, place = np.unique(at, return_inverse=True)
    total = np.bincount(place, weights=n, minlength=len(found)).astype(np.int64)
    return _table([row | {"at": _steps(found), "n": _packed(total)}], COMBINED)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
            total[_walked(at)] += _unpacked(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])


MOVED = "bucket int, part int, ids binary, class binary, turn binary"


def _moves(data: pa.Table, groups: pa.Table, pairs: np.ndarray, share: int, turn: int) -> pa.Table:
    """New classes of a bucket's words, ``share`` of TURNS of them from ``turn`` on, a row per group of blocks."""
    rows = groups.to_pylist()
    ids = {r["part"]: _walked(r["ids"]) for r in rows}
    width, size = 2 * CLASSES, max(int(x[-1]) for x in ids.values()) + 1
    classes, turns = np.full(size, UNKNOWN, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for r in rows:
        classes[ids[r["part"]]] = np.frombuffer(r["class"], dtype=np.uint8)
        turns[ids[r["part"]]] = np.frombuffer(r["turn"], dtype=np.uint8)
    moving = np.flatnonzero((classes != UNKNOWN) & ((turns + turn) % TURNS < share))
    if len(data):
        at, n = _cells_of(data, [ids[p] for p in data.column("part").to_pylist()], width)
        both = np.bincount(at, weights=n, minlength=size * width).reshape(size, 2, CLASSES)
        classes[moving] = _moved(classes[moving], both[moving, 0], both[moving, 1], pairs)
    classes = classes.astype(np.uint8)
    return _table([r | {"class": classes[ids[r["part"]]].tobytes()} for r in rows], MOVED)


def _returned(data: pa.Table, group: pa.Table) -> pa.Table:
    """New classes of the words of each block of a group."""
    classes = np.frombuffer(group.column("class")[0].as_py(), dtype=np.uint8)
    rows = [{"block": b, "bucket": k, "class": classes[_walked(i)].tobytes()}
            for b, k, i in zip(*[data.column(x).to_pylist() for x in ("block", "bucket", "ids")])]
    return _table(rows, "block long, bucket int, class binary")


def likelihood(pairs: np.ndarray) -> float:
    """What the classes add to the mean log-likelihood of a training token: the mutual information of neighbours."""
    p = pairs / max(pairs.sum(), 1)
    alone = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log(p[some] / alone[some])).sum())


def _moved(classes: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best class of every word: the likelihood of its neighbours' classes and of itself in the class.

    A word's own share is taken out of the counts of the class it is in.
    """
    weight = left.sum(axis=1)
    mass = np.maximum(pairs.sum(axis=0), 1.0)
    onto = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * CLASSES))  # [before, class]
    gain = left @ onto + right @ onto.T - weight[:, None] * np.log(mass)[None, :]
    own = np.arange(len(classes)), classes
    less = np.maximum(pairs[:, classes].T - left, 0) + 0.5  # [word, before]
    less_after = np.maximum(pairs[classes] - right, 0) + 0.5
    rows = pairs.sum(axis=1) + 0.5 * CLASSES
    rest = np.maximum(mass[classes] - weight, 0.5)
    gain[own] = (
        (left * np.log(less / rows)).sum(axis=1)
        + (right * np.log(less_after / (rest + 0.5 * CLASSES)[:, None])).sum(axis=1)
        - weight * np.log(rest)
    )
    gain[:, END] = -np.inf
    return np.round(gain, 9).argmax(axis=1)  # of equally good classes the first


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(data: pa.Table, classes: pa.Table, pairs: np.ndarray, total: int, kinds: int, texts: int) -> pa.Table:
    codes, places, kind, before, sizes, _ = _chain(data, classes)
    mass = np.append(pairs.sum(axis=0), 0)
    onto = (pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 0.1 * CLASSES)
    onto = np.vstack([onto, (mass[:-1] + 0.1) / (mass.sum() + 0.1 * CLASSES)])  # after an unknown word
    onto = np.hstack([onto, np.zeros((CLASSES + 1, 1))])
    count = np.full(len(kind), texts, dtype=np.int64)
    count[places] = _unpacked(data.column("c")[0].as_py())[codes]
    base = (count + 1) / (total + kinds + 1)
    p = (1 - MIX) * onto[before, kind] * count / np.maximum(mass[kind], 1) + MIX * base
    begins = np.cumsum(sizes) - sizes
    out = [pa.array(data.column(x)[0].as_py(), t) for x, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()))]
    out += [pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), begins))]
    out += [pa.array(np.add.reduceat(np.log10(x), begins)) for x in (base, p)]
    return pa.Table.from_arrays(out, names=[x.split()[0] for x in SCORES.split(", ")])


def score_texts(docs: DataFrame, gain: float = GAIN, rounds: int | None = None, told: list | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10) of every row.

    The model learns from rows whose crc32(doc_id) mod 7 is not 2 (a null doc_id counts as the empty string).
    Words are lower-cased (A-Z); every text has one end token more. A null text is empty. Words unknown to
    the training part get the base share only. Repeated rows are scored, and counted, each. An empty
    training part gives base probabilities over one kind. Other columns are not looked at. The exchange ends when a round gains
    less than ``gain``, or after ``rounds`` where that is given; ``told`` receives the likelihood of every round that stands.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    dealt = written(rows.mapInArrow(_blocks, BLOCK), "blocks", "zstd")
    texts = rows.where(~F.col("held_out")).count()
    blocks = dealt.where("bucket < 0").count()
    groups = -(-blocks // max(LEAST_GROUP, isqrt(blocks)))
    of = F.pmod(F.xxhash64("block"), F.lit(max(groups, 1))).cast("int").alias("part")
    buckets = max(parts_of(spark), blocks // BLOCKS_PER_BUCKET)
    words = dealt.where("bucket >= 0").select("block", of, "h", "n").mapInArrow(lambda it: _bucketed(it, buckets), BUCKETED)
    partial = words.groupBy("bucket", "part").applyInArrow(_partial_words, PARTIAL)
    classed = written(partial.groupBy("bucket").applyInArrow(_bucket_words, GROUPS), "groups", "zstd")
    found = classed.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = (found["n"] or 0) + texts, (found["v"] or 0) + (texts > 0)
    words = words.groupBy("bucket", "part").cogroup(classed.groupBy("bucket", "part"))
    words = written(words.applyInArrow(_block_words, WORDS), "words", "zstd")
    coded = dealt.where("bucket < 0").groupBy("block").cogroup(words.select("block", "bucket", "part", "ids", "c").groupBy("block"))
    coded = written(coded.applyInArrow(_coded, CODED), "coded", "zstd")
    dropped(dealt)
    classes, classed = words.select("block", "bucket", "class"), classed.select("bucket", "part", "ids", "class", "turn")
    owners = words.select("block", "bucket", "part", "ids")

    def counted(classes: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The round's counts by bucket, and the class pairs."""
        sums = coded.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_sums, SUMS)
        sums = written(sums.groupBy("bucket", "part").applyInArrow(_combined, COMBINED), "sums", "zstd")
        got = sums.where("bucket < 0").select("at", "n").mapInArrow(_pair_rows, "at long, n long")
        got = got.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        pairs = np.zeros(CLASSES * CLASSES)
        pairs[got.column("at").to_numpy()] = got.column("n").to_numpy()
        return sums, pairs.reshape(CLASSES, CLASSES)

    sums, pairs = counted(classes)
    heard: list[float] = [] if told is None else told
    heard.append(likelihood(pairs))
    share, turn = TURNS, 0
    while share and turn != rounds:
        moved = sums.where("bucket >= 0").groupBy("bucket").cogroup(classed.groupBy("bucket"))
        moved = written(moved.applyInArrow(lambda x, y: _moves(x, y, pairs, share, turn * share), MOVED), "classed", "zstd")
        back = owners.groupBy("bucket", "part").cogroup(moved.groupBy("bucket", "part"))
        back = written(back.applyInArrow(_returned, "block long, bucket int, class binary"), "classes", "zstd")
        new, new_pairs = counted(back)
        turn, rise = turn + 1, likelihood(new_pairs) - heard[-1]
        if rise < 0:
            share //= 2
            dropped(new, moved, back)
            continue
        heard.append(likelihood(new_pairs))
        old = [sums] if len(heard) == 2 else [sums, classed, classes]  # the first classes stand with the words
        sums, pairs, classed, classes = new, new_pairs, moved, back
        dropped(*old)  # nothing reads the round before again
        if rise < gain * share / TURNS:
            break
    scored = coded.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(
        lambda x, y: _scored(x, y, pairs, total, kinds, texts), SCORES
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op5_language_scores(spark: SparkSession, directory: str) -> DataFrame:
    return score_texts(table(spark, directory, "documents").select("doc_id", "text"))
