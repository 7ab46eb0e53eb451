"""Best-fit packing of documents into bins of `capacity` tokens by hierarchical residual packing.

A document's length is its number of tokens with one more for its end. It is cut
at multiples of the capacity; whole pieces are bins of their own and the rest is
an item. Items are spread by a hash over partitions and packed there, longest
first, each into the fullest bin that still holds it. Bins filled to `full` of
the capacity are emitted; of the others those rise as items that a merge can use, and
`fan_in` partitions at a time merge and pack them again, until one partition is left, which
emits all. Of two bins that become one, one is at most half full, and best fit leaves a
partition at most one such bin; so all merges together bring a partition at most as many as
there are other partitions. Its own rises, with so many of its least full other bins for those
to go into. A bin that fits one of the rest fits all of these, and they are not all taken
before it; so the rest, which are emitted, would not save a bin by rising, whatever `fan_in`.
No task of a merge sees more than `fan_in` times as many bins as there are partitions.

The fullest bin that fits is found in a bit set of free capacities, so an item
costs about a microsecond and bins a few bytes each. Only ids and lengths move.

Without a column of lengths a document has a token for every four bytes begun.

Defined results: a null or empty text has its end only, length 1; a null or
negative length counts as 0; every row, repeated or not, is placed once; null ids
are placed too; columns of other names are not read; no rows make no bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

PIECES = "array<struct<doc_id: long, start: long, length: long>>"
BINS = f"bin_id long, part int, fill long, done boolean, pieces {PIECES}"
PIECE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given: the fullest bin that holds it, of equal ones the oldest; else a new bin."""
    free: dict[int, list[int]] = {}  # free capacity -> heap of bins
    has = 0  # bit c: a bin has c free
    left: list[int] = []
    out = []
    for size in sizes:
        fit = has >> size
        if fit:
            c = size + (fit & -fit).bit_length() - 1
            one = heapq.heappop(free[c])
            if not free[c]:
                has &= ~(1 << c)
        else:
            one, c = len(left), capacity
            left.append(capacity)
        out.append(one)
        left[one] = rest = c - size
        if rest:
            heap = free.setdefault(rest, [])
            heapq.heappush(heap, one)
            has |= 1 << rest
    return out


def finished(fill: list[int], capacity: int, full: int, hosts: int) -> list[bool]:
    """Whether each bin of a partition is emitted; hosts: how many bins at most half full the others can bring."""
    done = [x >= full for x in fill]
    half = [i for i, x in enumerate(fill) if not done[i] and 2 * x > capacity]
    half.sort(key=lambda i: (fill[i], i))
    for i in half[hosts:]:
        done[i] = True
    return done


def _pack(capacity: int, full: int, level: int, last: bool, hosts: int):
    def one(part: int, rows: list[tuple[int, list[dict]]]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda x: (-x[0], [(p["doc_id"] is None, p["doc_id"] or 0, p["start"]) for p in x[1]]))
        where = best_fit([x[0] for x in rows], capacity)
        fill = [0] * (max(where, default=-1) + 1)
        pieces: list[list[dict]] = [[] for _ in fill]
        for (size, own), at in zip(rows, where):
            fill[at] += size
            pieces[at] += own
        done = [True] * len(fill) if last else finished(fill, capacity, full, hosts)
        names = [(level << 58) | (part << 32) | i for i in range(len(fill))]
        for at in range(0, len(fill), 20_000):
            f = fill[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at : at + 20_000], pa.int64()), pa.array([part] * len(f), pa.int32()), pa.array(f, pa.int64()), pa.array(done[at : at + 20_000], pa.bool_()), pa.array(pieces[at : at + 20_000], PIECE_TYPE)],
                ["bin_id", "part", "fill", "done", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, list[dict]]]] = {}
        for b in batches:
            for part, fill, own in zip(b["part"].to_pylist(), b["fill"].to_pylist(), b["pieces"].to_pylist()):
                parts.setdefault(part, []).append((fill, own))
        for part in sorted(parts):
            yield from one(part, parts.pop(part))

    return run


def byte_tokens(text_col: str = "text") -> Column:
    return F.ceil(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) / 4)


def packed(docs: DataFrame, capacity: int = 2048, full: float = 0.98, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", items_per_part: int = 50_000, fan_in: int = 8) -> DataFrame:
    """(bin_id, fill, pieces): every bin and the pieces of documents in it, each from token `start` on."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(docs.sparkSession)
    size = F.greatest(F.coalesce((byte_tokens(text_col) if length is None else length).cast("long"), F.lit(0)), F.lit(0)) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.xxhash64(text_col).alias("th"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long"))
    pieces = cut(rows.select("doc_id", "size", "th", F.explode(starts).alias("start")).select("doc_id", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).alias("length"), "th"))
    n = pieces.where(F.col("length") < capacity).count()
    parts = max(1, -(-n // items_per_part))
    own = F.array(F.struct("doc_id", "start", "length")).alias("pieces")
    whole = pieces.where(F.col("length") == capacity).select((F.lit(31 << 58) + F.monotonically_increasing_id()).alias("bin_id"), F.col("length").alias("fill"), own)
    items = pieces.where(F.col("length") < capacity).select(F.pmod(F.xxhash64("doc_id", "th", "start"), F.lit(parts)).cast("int").alias("part"), F.col("length").alias("fill"), own)
    done, level = [whole], 0
    while True:
        last = parts == 1
        bins = cut(items.repartition(parts, "part").mapInArrow(_pack(capacity, int(full * capacity), level, last, parts - 1), BINS))
        done.append(bins.where("done").select("bin_id", "fill", "pieces"))
        if last:
            return reduce(DataFrame.unionByName, done)
        items = bins.where("not done").select((F.col("part") / fan_in).cast("int").alias("part"), "fill", "pieces")
        parts, level = -(-parts // fan_in), level + 1
