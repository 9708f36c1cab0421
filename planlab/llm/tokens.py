"""Words of Arrow text batches as 64-bit hashes, computed on the UTF-8 bytes with numpy.

Used inside tasks only. A word is a maximal stretch of bytes other than 0x20 and 0x09-0x0D; in UTF-8
no other character contains those bytes. A word is hashed eight bytes at a time, each step mixed before the next
one, so no structure of its letters survives (words of up to eight bytes and equal length never meet); words above LONG
bytes take a BLAKE2b digest. Hashes of different seeds are independent, which is what a verification goes by.
Batches are worked through in pieces of a few megabytes, whole texts each, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
LONG = 64  # bytes of the longest word that is hashed step by step
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ROOT = U(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the polynomial's root and of its inverse, kept for the next piece."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _ROOT, dtype=np.uint64)
            up[0] = 1
            down = np.full(size, U(_inverse(int(_ROOT))), dtype=np.uint64)
            down[0] = 1
            _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


@dataclass
class Piece:
    """Words of consecutive texts of a batch: row range, bytes, word bounds, first word of each row."""

    first: int
    rows: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row_words: np.ndarray  # rows + 1 offsets into the words

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        sizes = self.ends - self.starts
        out = mix64(sizes.astype(np.uint64) * U(0xA24BAED4963EE407) + mix64(np.array([seed + 1], dtype=np.uint64)))
        padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
        padded[: len(self.data)] = _LOWER[self.data] if lower else self.data
        eights = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # from every byte on
        at, done = np.flatnonzero(sizes <= LONG), 0
        while len(at):
            rest = sizes[at] - done
            bits = (U(8) * (U(8) - np.minimum(rest, 8).astype(np.uint64)))
            letters = (eights[self.starts[at] + done] << bits) >> bits  # rest is at least 1 here
            out[at] = mix64(out[at] ^ (letters * _ROOT))
            done += 8
            at = at[rest > 8]
        for i in np.flatnonzero(sizes > LONG).tolist():
            word = padded[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.row_words))

    def sizes(self) -> np.ndarray:
        return np.diff(self.row_words)


def pieces(text: pa.Array) -> Iterator[Piece]:
    """Cut a text column into pieces of whole rows; a null text is an empty one."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(pc.cast(text, pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(text))
        yield _piece(first, offsets[first : last + 1], data)
        first = last


def _piece(first: int, offsets: np.ndarray, data: np.ndarray) -> Piece:
    part = data[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inner = bounds[:-1][np.diff(bounds) > 0]  # first byte of every text that has one
    blank = SPACE[part]
    opens = np.ones(len(part), dtype=bool)
    opens[1:] = blank[:-1]
    opens[inner] = True
    closes = np.ones(len(part), dtype=bool)
    closes[:-1] = blank[1:]
    closes[inner[1:] - 1] = True
    starts = np.flatnonzero(opens & ~blank)
    ends = np.flatnonzero(closes & ~blank) + 1
    return Piece(first, len(offsets) - 1, part, starts, ends, np.searchsorted(starts, bounds))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each position on (fewer positions than words)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, U(seed), dtype=np.uint64)
    for j in range(width):
        out *= U(0x9FB21C651E98DF25)
        out += words[j : j + n]
    return mix64(out)


def shingle_sets(piece: Piece, width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: windows of ``width`` words; a shorter text gives
    its whole word sequence as one shingle, a text without words none."""
    words = piece.hashes(lower)
    windows = window_hashes(words, width)
    out = []
    for a, b in zip(piece.row_words[:-1].tolist(), piece.row_words[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a, seed=b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
