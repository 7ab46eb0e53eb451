"""Tokens of a batch of texts as byte spans, found and counted with numpy.

The tokens are those of functions.text: runs of ASCII letters and digits and of bytes
of 0x80 and above, with ASCII letters lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_INSIDE = np.zeros(256, bool)
_INSIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _INSIDE[ord(_a) : ord(_b) + 1] = True
_LOWER[65:91] += 32
_MUL = 0x9E3779B97F4A7C15


class Tokens:
    """ptr[r]:ptr[r+1] are text r's tokens; start and end are offsets in buf. Nulls have none."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = _LOWER[raw[offs[0] : offs[-1]]]
        offs = offs - offs[0]
        inside = np.concatenate([[False], _INSIDE[self.buf], [False]])
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[offs] = True
        begins = inside[1:] & (~inside[:-1] | edge)
        ends = inside[:-1] & (~inside[1:] | edge)
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.ptr = np.searchsorted(self.start, offs)

    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    def count(self, term: str) -> np.ndarray:
        """How often a token occurs in each text."""
        raw = term.encode()
        at = np.flatnonzero(self.end - self.start == len(raw))
        for j, byte in enumerate(raw):
            at = at[self.buf[self.start[at] + j] == byte]
        return np.bincount(np.searchsorted(self.ptr, at, "right") - 1, minlength=len(self.ptr) - 1)

    def hashes(self) -> np.ndarray:
        """One number for each token, equal for equal tokens of this batch."""
        size = self.end - self.start
        out = size.astype(np.uint64)
        live = np.arange(len(size))
        j = 0
        while len(live):
            x = (out[live] ^ self.buf[self.start[live] + j]) * np.uint64(_MUL)
            out[live] = x ^ (x >> np.uint64(29))
            j += 1
            live = live[size[live] > j]
        return out

    def strings(self, at: np.ndarray) -> pa.Array:
        """Some tokens as strings."""
        size = self.end[at] - self.start[at]
        offs = np.append(0, np.cumsum(size)).astype(np.int64)
        where = np.repeat(self.start[at] - offs[:-1], size) + np.arange(offs[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(self.buf[where])).cast(pa.string())


SLICE = 2 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about SLICE bytes, each with its first row; a row is never cut."""
    size = np.cumsum(np.array([x or 0 for x in pa.compute.binary_length(texts).to_pylist()], np.int64)) if len(texts) else np.zeros(0, np.int64)
    first, done = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, done + SLICE, "right")))
        yield first, texts.slice(first, last - first)
        first, done = last, int(size[last - 1])


def term_counts(terms: Sequence[str]):
    """Of (id, text): id, number of tokens, and how often each term is among them, of texts that have a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(1)):
                t = Tokens(part)
                n = t.sizes()
                tf = np.stack([t.count(x) for x in terms], 1) if terms else np.zeros((len(n), 0), np.int64)
                at = np.flatnonzero(n)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(terms), pa.int32()), pa.array(tf[at].ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + first)), pa.array(n[at].astype(np.int32)), counts], ["id", "len", "tf"])

    return run


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text): term, id, its count in that text, and the text's number of tokens."""
    for b in batches:
        for first, part in slices(b.column(1)):
            t = Tokens(part)
            row = np.repeat(np.arange(len(part)), t.sizes())
            h = t.hashes()
            order = np.lexsort((h, row))
            new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(h) else np.zeros(0, np.int64)
            at = order[new]
            tf = np.diff(np.append(new, len(h)))
            yield pa.RecordBatch.from_arrays([t.strings(at), b.column(0).take(pa.array(row[at] + first)), pa.array(tf.astype(np.int64)), pa.array(t.sizes()[row[at]].astype(np.int32))], ["term", "id", "tf", "len"])
