"""Removal of repeated word sequences by recompression (operator 3).

Recompression rewrites a text in rounds. A round first names maximal runs of one symbol, then
splits all symbols into left and right ones and names every neighbouring pair (left, right). Names are
64-bit hashes of what they stand for, so equal substrings get equal interior symbols in every text
without any exchange between tasks; which side a symbol is on depends on its name and the round only.
With each symbol goes the stretch of words that decides that it stands there. A window of WINDOW
words takes, among the symbols whose deciding stretch lies inside it, the first one of the highest round: a
choice that depends on the window's words alone, so equal windows take the same symbol at the
same offset, and neighbouring windows share one. A window without such a symbol stands for itself.

Spark then works on far fewer rows than words:
1. symbol rounds: a row (name with its deciding words, text, place) per chosen symbol. Symbols that occur
   once rule out all windows that chose them; a whole text is named as well, so an exact copy of an
   earlier text is settled by its name alone.
2. verification: the windows left are named by 96 bits over all their words, from two independent hashes of
   each word; the least place per name is where it first occurs.
3. each text drops the words of its windows that are left and are no first occurrence.
Each grouping is an aggregation with map-side partial results, so names that fill a third of the corpus stay cheap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import joined_back, keyed, table, unkeyed
from planlab.llm.pipeline import written
from planlab.llm.tokens import U, Piece, mix64, pieces, powers, window_hashes

WINDOW = 20
ROUNDS = 5
WHOLE = -1  # place of a whole text's name
_PAIR = U(0x8CB92BA72F3D8DD7)
_RUN = U(0xA0761D6478BD642F)


def _pair_name(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix64(a * _PAIR + (b ^ (b >> U(31))) * _RUN + U(level))


def anchors(words: np.ndarray, row_words: np.ndarray, width: int, rounds: int = ROUNDS):
    """For each window start: the place of the symbol it takes and the kind of symbol (round, run or pair).

    Returns arrays over word positions: ``place`` (-1 where no window starts, the start of
    the deciding stretch otherwise), ``end`` of that stretch and ``name``. ``words`` are the hashes of the
    words of consecutive texts, ``row_words`` the offsets of the texts.
    """
    n = len(words)
    sizes = np.diff(row_words)
    first = np.repeat(row_words[:-1], sizes)  # first word of the text of each word
    last = np.repeat(row_words[1:], sizes)
    starts_window = np.arange(n) + width <= last
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    name, begin = words, np.arange(n)
    end, low, high = begin + 1, begin.copy(), begin + 1
    for level in range(1, rounds + 1):
        if len(name) < 2:
            break
        text = first[begin]
        # runs: equal neighbours of one text. That a run ends is decided by the next word where that
        # differs from the run's own, else by all that decides the neighbour.
        same = np.zeros(len(name), dtype=bool)
        same[1:] = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
        heads = np.flatnonzero(~same)
        tails = np.append(heads[1:], len(name)) - 1
        count = tails - heads + 1
        low_run, high_run = low[heads], high[tails]
        b, e = begin[heads], end[tails]
        before = np.maximum(heads - 1, 0)
        after = np.minimum(tails + 1, len(name) - 1)
        differs_before = words[np.maximum(b - 1, 0)] != words[end[heads] - 1]
        differs_after = words[np.minimum(e, n - 1)] != words[begin[tails]]
        edge_low = np.where(b == first[b], b - 1, np.where(differs_before, b - 1, low[before]))
        edge_high = np.where(e == last[b], e + 1, np.where(differs_after, e + 1, high[after]))
        low_run, high_run = np.minimum(low_run, edge_low), np.maximum(high_run, edge_high)
        runs = count > 1
        name = np.where(runs, mix64(name[heads] * _RUN + count.astype(np.uint64) * _PAIR + U(level)), name[heads])
        begin, end, low, high = b, e, low_run, high_run
        # pairs: a left symbol and the right one after it
        right = ((mix64(name + U(level * 7919)) >> U(17)) & U(1)).astype(bool)
        text = first[begin]
        joins = np.zeros(len(name), dtype=bool)  # symbol i and i + 1
        joins[:-1] = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        joined = np.zeros(len(name), dtype=bool)
        joined[1:] = joins[:-1]
        i = np.flatnonzero(joins)
        # a symbol that stays alone is decided by the neighbour it looked at as well
        alone = ~joins & ~joined
        next_high = np.append(high[1:], 0)
        next_high = np.where(end == last[begin], end + 1, next_high)
        prev_low = np.append(0, low[:-1])
        prev_low = np.where(begin == text, begin - 1, prev_low)
        high_new = np.where(alone & ~right, np.maximum(high, next_high), high)
        low_new = np.where(alone & right, np.minimum(low, prev_low), low)
        new_name = name.copy()
        new_name[i] = _pair_name(name[i], name[i + 1], level)
        end_new = end.copy()
        end_new[i] = end[i + 1]
        low_new[i] = np.minimum(low[i], low[i + 1])
        high_new[i] = np.maximum(high[i], high[i + 1])
        made = joins | (runs & ~joined)
        name, begin, end, low, high = (x[~joined] for x in (new_name, begin, end_new, low_new, high_new))
        made = made[~joined]
        inside = made & (low >= first[begin]) & (high <= last[begin])
        levels.append((low[inside], high[inside], name[inside]))
    place = np.full(n, -1, dtype=np.int64)
    stop = np.zeros(n, dtype=np.int64)
    names = np.zeros(n, dtype=np.uint64)
    open_ = starts_window.copy()
    for low, high, name in reversed(levels):
        if not len(low):
            continue
        # the first symbol whose stretch starts at or after the window start; stretches may share a
        # start, then the one that ends first counts
        order = np.lexsort((high, low))
        low, high, name = low[order], high[order], name[order]
        next_ = np.full(n + 1, len(low), dtype=np.int64)
        next_[low[::-1]] = np.arange(len(low))[::-1]
        next_ = np.minimum.accumulate(next_[::-1])[::-1][:n]
        at = np.flatnonzero(open_ & (next_ < len(low)))
        pick = next_[at]
        fits = high[pick] <= at + width
        at, pick = at[fits], pick[fits]
        place[at], stop[at], names[at] = low[pick], high[pick], name[pick]
        open_[at] = False
    rest = np.flatnonzero(open_)
    place[rest], stop[rest] = rest, rest + width
    return place, stop, names


def _polynomial(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums to hash a stretch of a few words, and the inverse powers to shift it to its start."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix64(words + U(seed)) * up[: len(words)], out=sums[1:])
    return sums, down


class _Lists:
    """A list column of places for the rows of a piece, searched for (row, place) pairs."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
        sizes = pc.list_value_length(column).to_numpy()
        self.rows = len(column)
        row = np.repeat(np.arange(self.rows), sizes)
        self.pairs = np.sort((row << 32) + pc.list_flatten(column).to_numpy().astype(np.int64) + 1)

    def holds(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        wanted = (row << 32) + at + 1
        if not len(self.pairs):
            return np.zeros(len(wanted), dtype=bool)
        return self.pairs[np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)] == wanted

    def copies(self) -> np.ndarray:
        """Rows that do not list WHOLE."""
        return ~self.holds(np.arange(self.rows), np.full(self.rows, WHOLE))


class _Text:
    """One piece with its windows and the symbols they take."""

    def __init__(self, piece: Piece, width: int):
        self.piece, self.width = piece, width
        self.words = piece.hashes()
        self.place, stop, names = anchors(self.words, piece.row_words, width)
        self.windows = np.flatnonzero(self.place >= 0)
        place, stop = self.place[self.windows], stop[self.windows]
        # windows that take one symbol are neighbours: a new symbol where place, stretch or name change
        name = names[self.windows]
        change = np.ones(len(place), dtype=bool)
        if len(place):
            change[1:] = (place[1:] != place[:-1]) | (stop[1:] != stop[:-1]) | (name[1:] != name[:-1])
        self.symbol = np.cumsum(change) - 1  # of each window
        self.heads = np.flatnonzero(change)
        a, b = place[self.heads], stop[self.heads]
        sums, down = _polynomial(self.words, 1)
        self.keys = mix64((sums[b] - sums[a]) * down[a] + name[self.heads] + (b - a).astype(np.uint64) * _PAIR)
        self.symbol_row = np.searchsorted(piece.row_words, self.windows[self.heads], side="right") - 1
        # a symbol is known by the start of its first window, which no other symbol of the text has
        self.symbol_at = self.windows[self.heads] - piece.row_words[:-1][self.symbol_row]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two names of each text as a whole: a digest of its words."""
        texts = _joined(self.piece, np.ones(len(self.words), dtype=bool))
        digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), dtype=np.uint64)
        return digests[::2], digests[1::2]

    def left(self, once: _Lists) -> np.ndarray:
        """Starts of the windows whose symbol occurs elsewhere, by the rows' lists of symbols that
        occur once; a row without WHOLE in its list is a copy and has none left."""
        known = ~once.holds(self.symbol_row, self.symbol_at) & ~once.copies()[self.symbol_row]
        return self.windows[known[self.symbol]] if len(self.windows) else self.windows


def _symbol_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            text = _Text(piece, width)
            rids = batch.column("rid").slice(piece.first, piece.rows).to_numpy()
            one, two = text.whole()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([text.keys, one]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(text.keys), dtype=np.uint64), two]).astype(np.uint32).view(np.int32)),
                    pa.array(np.concatenate([rids[text.symbol_row], rids])),
                    pa.array(np.concatenate([text.symbol_at, np.full(len(rids), WHOLE)]).astype(np.int32)),
                ],
                names=["name", "more", "rid", "at"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            text = _Text(piece, width)
            at = text.left(_Lists(batch.column("once").slice(piece.first, piece.rows)))
            rids = batch.column("rid").slice(piece.first, piece.rows).to_numpy()
            row = np.searchsorted(piece.row_words, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(window_hashes(text.words, width, 11)[at].view(np.int64)),
                    pa.array(window_hashes(piece.hashes(seed=5), width, 12)[at].astype(np.uint32).view(np.int32)),
                    pa.array(rids[row]),
                    pa.array((at - piece.row_words[:-1][row]).astype(np.int32)),
                ],
                names=["name", "more", "rid", "at"],
            )


def _joined(piece: Piece, kept: np.ndarray) -> list[bytes]:
    """The kept words of each row joined by one space: their bytes and the one behind each, as a space."""
    size = len(piece.data)
    inside = np.zeros(size + 1, dtype=np.int8)
    inside[piece.starts[kept]] += 1
    inside[piece.ends[kept]] -= 1
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    kept_at = np.flatnonzero(kept)
    row = np.searchsorted(piece.row_words, kept_at, side="right") - 1
    inner = np.zeros(len(kept_at), dtype=bool)
    inner[:-1] = row[:-1] == row[1:]  # another kept word of the row follows
    data = piece.data.copy()
    gaps = piece.ends[kept_at[inner]]
    data[gaps] = 0x20
    take[gaps] = True
    raw = data[take].tobytes()
    upto = np.concatenate([[0], np.cumsum(take)])
    # bytes of a row: from its first word to the last one
    a, b = piece.row_words[:-1], piece.row_words[1:]
    lows = np.where(b > a, upto[np.append(piece.starts, 0)[a]], 0)
    highs = np.where(b > a, upto[np.append(piece.ends, 0)[np.maximum(b - 1, 0)]], 0)
    return [raw[x:y] for x, y in zip(lows.tolist(), highs.tolist())]


def _removed(batches: Iterator[pa.RecordBatch], width: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Per row: words, words removed, digest of the kept words, and the kept words themselves."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            text = _Text(piece, width)
            once = _Lists(batch.column("once").slice(piece.first, piece.rows))
            firsts = _Lists(batch.column("firsts").slice(piece.first, piece.rows))
            at = text.left(once)
            row = np.searchsorted(piece.row_words, at, side="right") - 1
            at = at[~firsts.holds(row, at - piece.row_words[row])]
            # a copy of an earlier text: all its windows
            whole = text.windows[once.copies()[np.searchsorted(piece.row_words, text.windows, side="right") - 1]]
            change = np.zeros(len(text.words) + 1, dtype=np.int64)
            for gone in (at, whole):
                change += np.bincount(gone, minlength=len(change))
                change -= np.bincount(gone + width, minlength=len(change))
            kept = np.cumsum(change[:-1]) == 0
            kept_texts = _joined(piece, kept)
            sizes = piece.sizes()
            counts = np.concatenate([[0], np.cumsum(~kept)])
            removed = counts[piece.row_words[1:]] - counts[piece.row_words[:-1]]
            columns = {
                "rid": batch.column("rid").slice(piece.first, piece.rows),
                "n_words": pa.array(sizes.astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts]),
            }
            if texts:
                columns["kept_text"] = pa.array([t.decode("utf-8") for t in kept_texts])
            yield pa.RecordBatch.from_pydict(columns)


def remove_repeats(docs: DataFrame, width: int = WINDOW, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text``, per row of ``docs``.

    A window is ``width`` consecutive words of one text. Words covered by a window whose word
    sequence also starts earlier (smaller doc_id, null last, or the same text and an earlier start)
    are removed; windows are judged on the input. Null and empty texts have no words. Texts that
    share a doc_id are ordered by a digest; rows that repeat doc_id and text count as one text and get the same result.
    """
    base, back = keyed(docs)
    return unkeyed(_judged(base, width, texts), back)


def cut_texts(docs: DataFrame, name: str, width: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``name`` more: the kept words of each row's text, null where nothing was removed."""
    base, back = keyed(docs)
    cut = _judged(base, width, True).where("n_removed > 0").select("rid", F.col("kept_text").alias(name))
    return joined_back(docs, cut, back, "left")


def _judged(base: DataFrame, width: int, texts: bool) -> DataFrame:
    """The columns of ``remove_repeats`` by ``rid`` for every row of ``base`` (rid, text)."""
    base = base.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    symbols = base.mapInArrow(lambda it: _symbol_rows(it, width), "name long, more int, rid long, at int")
    found = symbols.groupBy("name", "more").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "at")).alias("p"))
    # a whole text's name is listed at its first text; a symbol where it occurs once
    once = found.where((F.col("c") == 1) | (F.col("p.at") == WHOLE)).groupBy("p.rid").agg(F.sort_array(F.collect_list("p.at")).alias("once"))
    # sorted lists in a compressed table take a fraction of a checkpoint; the hint keeps one plan at every size
    once = written(once, "once", "zstd").hint("merge")
    judged = base.join(once, "rid", "left")
    windows = judged.mapInArrow(lambda it: _window_rows(it, width), "name long, more int, rid long, at int")
    first = windows.groupBy("name", "more").agg(F.min(F.struct("rid", "at")).alias("p"))
    firsts = first.groupBy("p.rid").agg(F.collect_list("p.at").alias("firsts"))
    schema = "rid long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return judged.join(firsts, "rid", "left").mapInArrow(lambda it: _removed(it, width, texts), schema)


def op3_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return remove_repeats(docs, texts=False)
