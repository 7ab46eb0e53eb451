"""Language-model scores from a log-frequency Bloom filter.

Words, word pairs and word triples are counted over all documents. A count c is
quantised to the level 1 + floor(log2 c), and the filter holds each n-gram once for every
level from 1 up to its own, those seen once too. Workers probe the levels of an
n-gram upwards until one is missing, which gives its count back within a factor
of two (errors only raise it, each level with probability about 1 %).

A text is scored by what the other texts say: of an n-gram's count c its own k occurrences
in this text are taken away. c is 1 at level 1, else 1.5 * 2**(level - 1), and c' = c - k,
but 0 where k may be all of them (k >= 2**(level - 1)). A word's probability after a and b is

    0.6 * c'(abw) / c'(ab) + 0.3 * c'(bw) / c'(b) + 0.1 * (c'(w) + 1) / (N + V + 1)

where a count is at most that of its first words, and a fraction without a denominator
is 0. A text's second word has the last two terms (times 2.5), its first word the last one
(times 10).

Counts are combined with numpy by task, and move as small blobs of hashes by hash range;
each range has a task, which builds that range's part of the filter. A filter of at most
`mapped_bytes` is written part by part into a file in the shared folder of checkpoints, where that
is a folder of files (scheme file), and every worker maps that file; neither the driver nor an executor's JVM
holds it whole, and no text and no hash moves. Elsewhere a filter of at most
`broadcast_bytes` is broadcast. A larger one is never put together: distinct texts send the hashes of their n-grams to the parts, each part answers with levels, and the answers meet
their text again. Each part is loaded once, by one task. (That moves 8 bytes for every
distinct n-gram of every text, some seven times the input.)

Defined results: null, empty and wordless texts have 0 words and null scores; every
row, repeated or not, is counted and scored; null ids are passed on; columns of
other names are not read; an empty table has no scores.
"""

from __future__ import annotations

import atexit
import os
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_dir, ship
from . import _text as T

HELD = 3_000_000
#: Hashes of a blob, and bytes of blobs that are sent at once: the JVM copies them, and its heap grows by arrays of over half a megabyte.
BLOB = 24_000
SENT = 2 << 20
#: Hashes whose bits are set at once.
SET = 1 << 17
ORDERS = (1, 2, 3)
MIX = (0.1, 0.3, 0.6)
PROBES = 4
BITS = 10
TOP = 40
_STEP = 0x9E3779B97F4A7C15
LOW = np.uint64((1 << 48) - 1)


def summed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ascending ones, and how often each is there."""
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def grams(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some rows, and the word that each begins with."""
    h, begin = T.ngrams(w, n)
    return (T.mix(h) if n == 1 else h), begin


def packed(h: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes]:
    """The low 48 bits of hashes (all that the filter uses of them within a part), and counts, as bytes; a count is one byte, and from 255 on four more at the end."""
    big = c >= 255
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), np.where(big, 255, c).astype(np.uint8).tobytes() + c[big].astype(np.uint32).tobytes()


def unpacked(h: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(h, np.uint8).reshape(-1, 6)
    hashes = np.zeros((len(low), 8), np.uint8)
    hashes[:, :6] = low
    count = np.frombuffer(c, np.uint8, len(low)).astype(np.int64)
    if len(c) > len(low):
        count[count == 255] = np.frombuffer(c[len(low) :], np.uint32)
    return hashes.view(np.uint64).ravel(), count


def _count(parts: int):
    # The first hash of each part but part 0, as part_of has it
    border = np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)], np.uint64)

    def batch(rows: list[tuple[int, bytes, bytes]], order: int) -> pa.RecordBatch:
        part, h, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(rows), order, np.int32)), pa.array(h, pa.binary()), pa.array(c, pa.binary())], ["part", "n", "h", "c"])

    def blobs(held: list[np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
        """Empties held."""
        every = np.concatenate(held)
        held.clear()
        every.sort()
        at = [0, *np.searchsorted(every, border).tolist(), len(every)]
        rows: list[tuple[int, bytes, bytes]] = []
        size = 0
        for part in range(parts):
            h, c = summed(every[at[part] : at[part + 1]])
            for x in range(0, len(h), BLOB):
                rows.append((part, *packed(h[x : x + BLOB], c[x : x + BLOB])))
                size += sum(map(len, rows[-1][1:]))
                if size >= SENT:
                    yield batch(rows, order)
                    rows, size = [], 0
        if rows:
            yield batch(rows, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
        size = 0
        for b in batches:
            for s in T.slices(b.column(0)):
                w = T.words(s)
                for n in ORDERS:
                    held[n].append(grams(w, n)[0])
                size += len(w.h)
                if size >= HELD:
                    for order in held:
                        if held[order]:
                            yield from blobs(held[order], order)
                    size = 0
        for order in held:
            if sum(map(len, held[order])):
                yield from blobs(held[order], order)

    return run


def _halves(low: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the bits of hashes (their low 48 bits) at a level begin, and the step from one to the next."""
    g = T.mix(low + np.asarray(level).astype(np.uint64) * np.uint64(_STEP))
    return g >> np.uint64(32), (g & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def _spot(high: np.ndarray, step: np.ndarray, i: int, m: np.ndarray | np.uint64) -> np.ndarray:
    """The i-th bit of hashes, in a part of m bits."""
    return ((high + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * m >> np.uint64(32)


def built(h: np.ndarray, c: np.ndarray, min_count: int) -> np.ndarray:
    """The bits, as bytes, of one part."""
    keep = c >= max(1, min_count)
    if not keep.all():
        h, c = h[keep], c[keep]
    level = np.concatenate([np.zeros(0, np.int8), *(np.frexp(c[x : x + SET])[1].astype(np.int8) for x in range(0, len(c), SET))])
    m = 64 + BITS * int(level.sum())
    m += -m % 8
    bits = np.zeros(m, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        own = h[level >= j]
        for x in range(0, len(own), SET):
            high, step = _halves(own[x : x + SET] & LOW, j)
            for i in range(PROBES):
                bits[_spot(high, step, i, np.uint64(m)).view(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _sum(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and total counts of the blobs, which are emptied."""
    end = np.cumsum([0] + [len(h) // 6 for h, _ in blobs])
    h, c = np.zeros(end[-1], np.uint64), np.zeros(end[-1], np.int64)
    for at in reversed(range(len(blobs))):
        h[end[at] : end[at + 1]], c[end[at] : end[at + 1]] = unpacked(*blobs.pop())
    order = np.argsort(h)
    h, c = h[order], c[order]
    del order
    first = np.append(True, h[1:] != h[:-1])
    at = np.flatnonzero(first)
    c = np.add.reduceat(c, at)
    return h[first], c


def _build(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for part, n, h, c in zip(*(b[k].to_pylist() for k in ("part", "n", "h", "c"))):
                held.setdefault((part, n), []).append((h, c))
        for part, n in sorted(held):
            h, c = _sum(held.pop((part, n)))
            bits = built(h, c, min_count)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([len(bits)], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["part", "n", "bits", "size", "distinct", "total"])

    return run


@dataclass
class Filter:
    """Bits of some parts of one order, each from byte base[part] on and of m[part] bits; m is 0 for a part not held."""

    bits: np.ndarray
    base: np.ndarray
    m: np.ndarray

    def levels(self, h: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The level of each hash; levels up to a known one aren't probed."""
        part = part_of(h, len(self.m))
        base, m, low = self.base[part], self.m[part], h & LOW
        out = np.zeros(len(h), np.int64) if known is None else np.where(m > 0, known, 0)
        at = np.flatnonzero((m > 0) & (out < TOP - 1))
        while len(at):
            high, step = _halves(low[at], out[at] + 1)
            for i in range(PROBES):
                spot = _spot(high, step, i, m[at])
                hit = np.flatnonzero((self.bits[base[at] + (spot >> np.uint64(3)).view(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                if len(hit) < len(at):
                    at, high, step = at[hit], high[hit], step[hit]
            out[at] += 1
            at = at[out[at] < TOP - 1]
        return out


def surely(times: np.ndarray, min_count: int) -> np.ndarray | None:
    """The level that n-grams have at least which are so often in some of the counted texts, if the filter leaves none out."""
    return np.minimum(np.frexp(times)[1], TOP - 1).astype(np.int64) if min_count <= 1 else None


def loaded(rows: list, parts: int) -> Filter:
    base, m = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
    at = 0
    for r in rows:
        base[r["part"]], m[r["part"]] = at, 8 * r["size"]
        at += r["size"]
    return Filter(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows) or b"\0", np.uint8), base, m)


class Streamed:
    """The parts of a filter, which pickle as a list of bytearrays; they come to the driver one by one and are freed when written, which pickle does at most one item late."""

    def __init__(self, parts: Iterator):
        self.parts = parts

    def _each(self) -> Iterator[bytearray]:
        held: list[bytearray] = []
        for r in self.parts:
            held.append(bytearray(r["bits"]))
            yield held[-1]
            if len(held) > 2:
                held.pop(0).clear()

    def __reduce__(self) -> tuple:
        return list, (), None, self._each()


def opened(shared: Broadcast, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a broadcast list of parts of these sizes, and where each part begins.

    The workers of an executor share its file of the broadcast by mapping it; where that
    isn't to be had (as with encryption) each reads its own copy.
    """
    try:
        bits = np.memmap(shared._path, np.uint8, "r")
        begin, at = [], 0
        for size in sizes:
            mark = pickle.BYTEARRAY8 + size.to_bytes(8, "little")
            at += bytes(bits[at : at + 128]).index(mark) + len(mark)
            begin.append(at)
            at += size
        return bits, np.array(begin, np.int64)
    except (AttributeError, TypeError, OSError, ValueError):
        return np.frombuffer(b"".join(shared.value) or b"\0", np.uint8), np.cumsum([0, *sizes])[:-1]


def gathered(shared: Broadcast, index: list[tuple[int, int, int]], parts: int) -> dict[int, Filter]:
    """The whole filter by order, of its broadcast parts and their index (n, part, size)."""
    return placed(*opened(shared, [size for _, _, size in index]), index, parts)


def placed(bits: np.ndarray, begin: np.ndarray, index: list[tuple[int, int, int]], parts: int) -> dict[int, Filter]:
    """The whole filter by order, of its bytes and where each part of its index begins."""
    out = {n: Filter(bits, np.zeros(parts, np.int64), np.zeros(parts, np.uint64)) for n in ORDERS}
    for (n, part, size), at in zip(index, begin):
        out[n].base[part], out[n].m[part] = at, 8 * size
    return out


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct hash, which of them each hash is, and how often each is there."""
    order = np.argsort(h)
    held = h[order]
    new = np.append(True, held[1:] != held[:-1])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], which, np.diff(np.append(at, len(h)))


def counted(h: np.ndarray, row: np.ndarray, lookup: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """c' of each n-gram. An n-gram is looked up once, in however many texts it is, with how often it is there."""
    first, which, own = grouped(h + T.mix(row.astype(np.uint64)))
    h = h[first]
    once, back, _ = grouped(h)
    level = lookup(h[once], np.bincount(back, own).astype(np.int64))[back]
    low = np.exp2(np.maximum(level, 1) - 1.0)
    c = np.where(level > 1, 1.5 * low, level)
    return np.where((level > 0) & (own < low), c - own, 0.0)[which]


def log_probabilities(s: T.Slice, lookup: Callable[[int, np.ndarray, np.ndarray], np.ndarray], whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and the sum of the natural logarithms of their probabilities; lookup gives the levels of n-grams of an order, which are there so often."""
    w = T.words(s)
    n = np.diff(w.ptr)
    if not len(w.h):
        return n, np.zeros(s.rows)
    row, c = T.row_of(w.ptr), np.zeros((3, len(w.h) + 2))
    for order in ORDERS:
        h, begin = grams(w, order)
        if len(h):
            c[order - 1, begin] = counted(h, row[begin], lambda x, times, order=order: lookup(order, x, times))
    c[1] = np.minimum(c[1], c[0])
    c[2] = np.minimum(c[2], c[1])
    size = len(w.h)
    share = [np.divide(c[k], c[k - 1], out=np.zeros(size + 2), where=c[k - 1] > 0) for k in (1, 2)]
    p = MIX[0] * (c[0, :size] + 1) / whole
    place = np.arange(size) - w.ptr[row]
    two, three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    p[two] += MIX[1] * share[0][two - 1]
    p[three] += MIX[2] * share[1][three - 2]
    p[place == 0] /= MIX[0]
    p[place == 1] /= MIX[0] + MIX[1]
    total = np.zeros(s.rows)
    total[n > 0] = np.add.reduceat(np.log(p), w.ptr[:-1][n > 0])
    return n, total


def filters(docs: DataFrame, min_count: int, text_col: str, part_bytes: int) -> tuple[DataFrame, int]:
    """The filter's parts (part, n, bits, size, distinct, total), materialised, and their number."""
    text = docs.select(F.lower(F.col(text_col)).alias("t")).where("t is not null and t <> ''")
    size = text.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // part_bytes))
    blobs = text.mapInArrow(_count(parts), "part int, n int, h binary, c binary")
    return cut(blobs.repartitionById(parts, "part").mapInArrow(_build(min_count), "part int, n int, bits binary, size long, distinct long, total long")), parts


def memory() -> int:
    """Half of this machine's memory; the page cache should hold what workers map."""
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2


def shared_file(spark: SparkSession) -> str | None:
    """The path of a new file that all executors see, if their shared folder is one of files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return f"{uri.getPath()}/filter-{uuid.uuid4().hex}" if uri.getScheme() == "file" else None


def _write(path: str, base: dict[tuple[int, int], int]):
    """Parts (n, part, bits) into their places in one file; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                for n, part, bits in zip(b["n"].to_pylist(), b["part"].to_pylist(), b["bits"]):
                    f.seek(base[n, part])
                    f.write(bits.as_buffer())
                yield b.select(["n", "part"])

    return run


def _ask(parts: int):
    """Of distinct texts (a, b, t): the hashes of their n-grams, in order, by order and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column(2)):
                w = T.words(s)
                row_of = T.row_of(w.ptr)
                for n in ORDERS:
                    h, begin = grams(w, n)
                    order = np.lexsort((h, row_of[begin]))
                    h, row = h[order], row_of[begin][order]
                    if not len(h):
                        continue
                    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
                    h, row = h[new], row[new]
                    part = part_of(h, parts)
                    at = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])))
                    end = np.append(at[1:], len(h))
                    own = pa.array(row[at] + s.first)
                    yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(np.ones(len(at), np.int32)), pa.array(np.full(len(at), n, np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.array([h[x:y].tobytes() for x, y in zip(at, end)], pa.binary())], ["part", "kind", "n", "a", "b", "x"])

    return run


def _answer(parts: int):
    """Rows (part, kind, n, a, b, x) ordered by part and kind: the filter's, of kind 0, answer the others with levels of a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, {}
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("part", "kind", "n", "a", "b", "x")]
            out = []
            for p, kind, n, a, b, x in zip(*columns):
                if p != part:
                    part, held = p, {}
                if kind == 0:
                    held[n] = loaded([{"part": p, "size": len(x), "bits": x}], parts)
                else:
                    h = np.frombuffer(x, np.uint64)
                    out.append((p, 1, n, a, b, (held[n].levels(h) if n in held else np.zeros(len(h))).astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "kind", "n", "a", "b", "x"])

    return run


def _meet(whole: int):
    """Rows (a, b, kind, n, part, x, t) ordered so: a text, of kind 0, and then its levels."""

    def scored(text: tuple, got: dict[int, list[bytes]]) -> tuple:
        levels = {n: np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for n, x in got.items()}

        def lookup(n: int, h: np.ndarray, times: np.ndarray) -> np.ndarray:
            return levels[n][np.unique(h, return_inverse=True)[1]]

        n, total = log_probabilities(next(T.slices(pa.array([text[2]]), 1 << 62)), lookup, whole)
        return text[0], text[1], int(n[0]), float(total[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, got, out = None, {}, []

        def flush() -> pa.RecordBatch:
            rows = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "n_words", "total"])

        for batch in batches:
            for a, b, kind, n, x, t in zip(*(batch[c].to_pylist() for c in ("a", "b", "kind", "n", "x", "t"))):
                if kind == 0:
                    if text:
                        out.append(scored(text, got))
                    text, got = (a, b, t), {}
                else:
                    got.setdefault(n, []).append(x)
            yield flush()
        if text:
            out.append(scored(text, got))
            yield flush()

    return run


def _joined(rows: DataFrame, table: DataFrame, parts: int, whole: int) -> DataFrame:
    """(a, b, n_words, total) of the distinct texts of rows (a, b, t)."""
    texts = cut(rows.where("t is not null").groupBy("a", "b").agg(F.first("t").alias("t")))
    asked = texts.mapInArrow(_ask(parts), "part int, kind int, n int, a long, b long, x binary")
    held = table.select("part", F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("bits").alias("x"))
    answers = asked.unionByName(held).repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_answer(parts), "part int, kind int, n int, a long, b long, x binary")
    whole_text = texts.select(F.lit(0).alias("part"), F.lit(0).alias("kind"), F.lit(0).alias("n"), "a", "b", F.lit(None).cast("binary").alias("x"), "t")
    both = answers.withColumn("t", F.lit(None).cast("string")).unionByName(whole_text)
    return both.repartition("a", "b").sortWithinPartitions("a", "b", "kind", "n", "part").mapInArrow(_meet(whole), "a long, b long, n_words long, total double")


def scored(docs: DataFrame, min_count: int = 1, broadcast_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 16 << 20, mapped_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, log10_prob, perplexity) of every row; log10_prob is the mean over its words."""
    spark = docs.sparkSession
    ship(spark)
    table, parts = filters(docs, min_count, text_col, part_bytes)
    stats = table.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("n") == 1, F.col("total"))).alias("total"), F.sum(F.when(F.col("n") == 1, F.col("distinct"))).alias("distinct")).first()
    whole = (stats["total"] or 0) + (stats["distinct"] or 0) + 1
    mean = F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))
    result = ["doc_id", "n_words", (mean / F.lit(float(np.log(10)))).alias("log10_prob"), F.exp(-mean).alias("perplexity")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, F.lit(1)).alias("b"), F.lower(F.col(text_col)).alias("t"))
    size = stats["size"] or 0
    path = shared_file(spark) if 0 < size <= (memory() if mapped_bytes is None else mapped_bytes) else None
    if size > broadcast_bytes and path is None:
        scores = _joined(rows.select("a", "b", "t"), table, parts, whole)
        both = rows.select("doc_id", "a", "b").join(scores, ["a", "b"], "left")
        return both.withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long"))).select(*result)
    index: list[tuple[int, int, int]] = []
    if path:
        index += [(r["n"], r["part"], r["size"]) for r in table.select("n", "part", "size").collect()]
        begin = np.cumsum([0] + [own for _, _, own in index])[:-1]
        with open(path, "wb") as f:
            f.truncate(size)
        atexit.register(Path(path).unlink, True)
        table.select("n", "part", "bits").mapInArrow(_write(path, {(n, part): int(at) for (n, part, _), at in zip(index, begin)}), "n int, part int").count()

        def held() -> dict[int, Filter]:
            return placed(np.memmap(path, np.uint8, "r"), begin, index, parts)

    else:

        def each() -> Iterator:
            for r in table.select("n", "part", "size", "bits").toLocalIterator():
                index.append((r["n"], r["part"], r["size"]))
                yield r

        shared = spark.sparkContext.broadcast(Streamed(each()))

        def held() -> dict[int, Filter]:
            return gathered(shared, index, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held()
        for b in batches:
            for s in T.slices(b.column(1)):
                n, total = log_probabilities(s, lambda order, h, times: found[order].levels(h, surely(times, min_count)), whole)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), pa.array(n.astype(np.int64)), pa.array(total)], ["doc_id", "n_words", "total"])

    return rows.select("doc_id", "t").mapInArrow(run, "doc_id long, n_words long, total double").select(*result)
