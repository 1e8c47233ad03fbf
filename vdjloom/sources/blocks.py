"""Gzip files made of blocks, read from any place.

Each block is a gzip member whose extra field ``BC`` states its whole size, so a
reader finds the blocks after any byte by their headers, without what lies before.
"""

from __future__ import annotations

import zlib

# The start of a member with an extra field, and the subfield of a block's size less 1.
MEMBER = b"\x1f\x8b\x08\x04"
SIZE_FIELD = b"BC\x02\x00"
LARGEST = 1 << 16  # bytes of a block


def _head(data: bytes, at: int) -> tuple[int, int] | None:
    """(whole size, size of the head) of the block whose head lies at ``at``."""
    if data[at:at + 4] != MEMBER or len(data) < at + 12:
        return None
    extra = int.from_bytes(data[at + 10:at + 12], "little")
    here, stop = at + 12, at + 12 + extra
    while here + 4 <= min(stop, len(data)):
        length = int.from_bytes(data[here + 2:here + 4], "little")
        if data[here:here + 4] == SIZE_FIELD and here + 6 <= len(data):
            size = int.from_bytes(data[here + 4:here + 6], "little") + 1
            return (size, 12 + extra) if size >= extra + 20 else None
        here += 4 + length
    return None


def is_blocked(first: bytes) -> bool:
    """Whether a file that opens with these bytes is made of blocks."""
    return _head(first, 0) is not None


def _block(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, size) of a whole and sound block at ``at``."""
    head = _head(data, at)
    if head is None or at + head[0] > len(data):
        return None
    size, skip = head
    tail = data[at + size - 8:at + size]
    try:
        content = zlib.decompress(data[at + skip:at + size - 8], wbits=-15)
    except zlib.error:
        return None
    sound = zlib.crc32(content) == int.from_bytes(tail[:4], "little") and len(content) == int.from_bytes(tail[4:], "little")
    return (content, size) if sound else None


class BlockStream:
    """Contents from the first block at or after ``begin``; ``start`` is its place, None if it is not before ``end``."""

    def __init__(self, source, begin: int, end: int):
        self._source, self._end = source, end
        self._data, self._at = b"", begin   # compressed bytes not yet read out, and their place in the file
        self._given, self._limit = 0, None
        source.seek(begin)
        self.start = self._find(begin)

    def _find(self, begin: int) -> int | None:
        self._fill(min(2 * LARGEST, self._end - begin + LARGEST))
        here = 0 if begin == 0 else self._data.find(MEMBER)
        while 0 <= here < self._end - begin:
            self._drop(here)
            self._fill(LARGEST)
            if begin == 0 or _block(self._data, 0):
                return self._at
            here, begin = self._data.find(MEMBER, 1), self._at
        if here < 0 and self._data and begin + len(self._data) < self._end:
            raise ValueError(f"no block within {len(self._data)} bytes after byte {begin}")
        return None

    def _fill(self, size: int) -> None:
        while len(self._data) < size:
            more = self._source.read(max(size - len(self._data), 1 << 20))
            if not more:
                return
            self._data += more

    def _drop(self, size: int) -> None:
        self._data, self._at = self._data[size:], self._at + size

    def limit(self) -> int | None:
        """The content before the next range's first block, and its first byte; None until that block is reached."""
        return self._limit

    def read(self, size: int) -> bytes:
        """About ``size`` bytes of content, at least one unless the file is at its end."""
        out, length = [], 0
        while length < size:
            self._fill(LARGEST)
            if not self._data:
                break
            if self._at >= self._end and self._limit is None:
                self._limit = self._given + length + 1
            block = _block(self._data, 0)
            if block is None:
                raise ValueError(f"broken block at byte {self._at}")
            out.append(block[0])
            length += len(block[0])
            self._drop(block[1])
            if self._limit is not None and length:  # little is needed beyond the end
                break
        self._given += length
        return b"".join(out)
