"""Words of many texts at once, found and hashed in whole Arrow buffers.

A text is cut at a set of one-byte separators; every other byte, so every byte
of a character beyond ASCII, belongs to a word.  The hash of a byte range comes
from one prefix sum of ``table[byte] * BASE**position`` modulo 2**64, so a slice
of text costs a handful of array passes, whatever the number of its words.
Texts made for it can collide; nothing that must be equal is decided by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; one text longer than this is a slice of its own.
SLICE = 1 << 20
#: Bytes of text whose rows are sent back together, so that neither side holds a second copy of a whole batch.
SEND = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space and all ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_TABLE = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}
#: Powers that a process keeps.
KEPT = SLICE + 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for slices, not for a longer text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, KEPT)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size == KEPT:
            _powers[base] = have
    return have[:n]


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; k - 1 fewer than there are values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=p[1:])
    return mix((p[k:] - p[:-k]) * powers(INVERSE, n))


class Words:
    """Words of one slice: where each starts and ends, its text and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~separators[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offsets[:-1] < offsets[1:]
        edge = offsets[:-1][full]
        first[edge] = word[edge]
        edge = offsets[1:][full] - 1
        last[edge] = word[edge]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self._prefix: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first bytes, up to the end of the character that they end in."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            terms, power = self._prefix[1:], powers(BASE, len(self.data))
            for z in range(0, len(terms), SLICE):
                np.multiply(_TABLE[self.data[z : z + SLICE]], power[z : z + SLICE], out=terms[z : z + SLICE])
            np.cumsum(terms, out=terms)
        end = self.end if first_bytes is None else np.minimum(self.end, self.start + first_bytes)
        for _ in range(0 if first_bytes is None else 3):
            inner = end < self.end
            inner[inner] = self.data[end[inner]] & 0xC0 == 0x80
            end = end + inner
        salt = U(0 if first_bytes is None else first_bytes * 0x632BE59BD9B4E019 % (1 << 64))
        return mix((self._prefix[end] - self._prefix[self.start]) * powers(INVERSE, max(1, len(self.data)))[self.start] ^ salt)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def parts_of(batch: pa.RecordBatch, text_at: int, limit: int = SEND) -> Iterator[pa.RecordBatch]:
    """The batch's rows in runs of about ``limit`` bytes of the text in that column."""
    for i, j, _, _ in slices(batch.column(text_at), limit):
        yield batch.slice(i, j - i)
