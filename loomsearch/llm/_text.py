"""Vectorised text kernel shared by the operators of this subpackage.

Texts arrive as Arrow string arrays. A slice of rows is viewed as one byte
buffer, and words, sentences, lines and n-grams of all its rows are found and
hashed with numpy, so that the cost is a few nanoseconds per byte and no Python
object is made per word.

Words are maximal runs of ASCII letters and digits and of bytes of 0x80 and
above (that is, every non-ASCII character counts as a letter). Callers pass
text that Spark has already lower-cased when case must not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
IS_WORD[0x80:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    IS_WORD[ord(_a) : ord(_b) + 1] = True
IS_END = np.zeros(256, bool)
IS_END[[ord(c) for c in ".!?"]] = True
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(SLICE_BYTES + 1, n)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 8 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some rows of a column: row numbers, their bytes, and the row borders."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into runs of rows of about max_bytes; nulls are empty texts.

    A row is never cut: one that is longer makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


@dataclass
class Words:
    """ptr[r]:ptr[r+1] are row r's words; start and end are byte offsets; h is a hash of the bytes."""

    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray


def words(s: Slice) -> Words:
    buf, offs = s.buf, s.offs
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(s.rows + 1, np.int64), none, none, none.astype(np.uint64))
    inside = IS_WORD[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    filled = offs[:-1][offs[:-1] < offs[1:]]
    before[filled] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[filled[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    ptr = np.searchsorted(start, offs)
    return Words(ptr, start, end, span_hash(buf, start, end))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans of a buffer, equal for equal bytes anywhere."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_R, len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_R_INV, len(buf) + 1)[start])


def run_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes: equal for equal words in equal order."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_Q_INV, len(h) + 1)[start])


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within a row and the number of the word each begins at."""
    if len(w.h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(len(w.h) - n + 1, bool)
    for border in range(1, n):
        at = w.ptr[1:-1] - border
        ok[at[(at >= 0) & (at < len(ok))]] = False
    begin = np.flatnonzero(ok)
    if n == 1:
        return w.h, begin
    out = np.zeros(len(w.h) - n + 1, np.uint64)
    for j in range(n):
        out = out * _Q + w.h[j : len(w.h) - n + 1 + j]
    return mix(out[begin]), begin


def row_of(ptr: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def sentences(s: Slice, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word borders of sentences and each one's row.

    A sentence ends at a newline, at the end of a row, or after '.', '!' or '?'
    before white space. Stretches without a word make no sentence of their own.
    Returns first words (with the number of all words at the end) and rows.
    """
    n = len(w.h)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    buf = s.buf
    blank = IS_BLANK[buf]
    stop = np.zeros(len(buf), bool)
    stop[:-1] = IS_END[buf[:-1]] & blank[1:]
    stop |= buf == 10
    at = np.flatnonzero(stop)
    first = np.searchsorted(w.start, at)
    mark = np.zeros(n + 1, bool)
    mark[first] = True
    mark[w.ptr[:-1]] = True
    begin = np.flatnonzero(mark[:n])
    return np.append(begin, n), np.searchsorted(w.ptr, begin, "right") - 1


def simhash(w: Words, h: np.ndarray, begin_ptr: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row's features h[begin_ptr[r]:begin_ptr[r+1]]; 0 without features.

    Each feature votes on every bit; a tie gives 0. Votes are added eight lanes
    of a byte to a word, in blocks of at most 255 features.
    """
    rows = len(begin_ptr) - 1
    out = np.zeros(rows, np.uint64)
    count = np.diff(begin_ptr)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    blocks = -(-count[some] // 255)
    owner = np.repeat(np.arange(len(some)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = begin_ptr[:-1][some][owner] + 255 * nth
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    part = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(len(begin), 64)
    votes = np.add.reduceat(part.astype(np.int32), np.cumsum(blocks) - blocks, axis=0)
    bits = votes * 2 > count[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
