"""Words of many texts at once, as 64-bit hashes, with numpy.

A word is a run of ASCII letters, digits and bytes from 0x80 up, after A-Z is
lower-cased.  A word's hash is a polynomial over its bytes, taken from prefix
sums, so the cost is a few array passes over the bytes and none per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of text that are worked on together.
PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, dtype=np.uint64)], dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix finalizer)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the rows first..last-1 of a column, in order."""

    first: int
    last: int
    data: np.ndarray  # lower-cased bytes of these rows
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    row: np.ndarray  # of each word, from 0 at first
    prefix: np.ndarray | None  # sums for hashes; None if taken in parts
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def bounds(self) -> np.ndarray:
        """Where each row's words begin; one more entry at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
        return mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word hashes; a very long row is taken in parts that end between words."""
    if len(data) <= 2 * PIECE:
        return _span_hash(data, start, end)
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + PIECE, side="right")))
        out[i:j] = _span_hash(data[low:end[j - 1]], start[i:j] - low, end[i:j] - low)
        i = j
    return out


def scan(column: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[Words]:
    """Words of a text column, some rows at a time; every row is in one piece."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, rows)
        piece = _LOWER[data[offsets[first]:offsets[last]]]
        edges = offsets[first:last + 1] - offsets[first]
        is_word = np.zeros(len(piece) + 2, dtype=bool)
        is_word[1:-1] = _IS_WORD[piece]
        begins = is_word[1:] & ~is_word[:-1]
        ends = is_word[:-1] & ~is_word[1:]
        # A word also ends where its row ends.
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(piece))]
        cut = inner[is_word[inner] & is_word[inner + 1]]
        begins[cut] = True
        ends[cut] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        row = np.searchsorted(edges, start, side="right") - 1
        yield Words(first, last, piece, start, end, row, None, _hashes(piece, start, end))
        first = last


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (rows are not told apart here)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(_BASE) + h[j:j + n]
    return mix(out)


def prefix_hashes(words: Words, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes of each word (all, if it is shorter)."""
    return _hashes(words.data, words.start, np.minimum(words.start + length, words.end))
