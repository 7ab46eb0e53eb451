"""Sharding by Karmarkar-Karp differencing.

Groups of documents that must stay together (by default documents of equal text)
are dealt to `shards` shards so that the shards' bytes differ as little as may be.
A partial partition is a list of subsets with their sums; a single group is one
with a subset of its own bytes and the others empty. The two partial partitions
with the largest spread are combined again and again, the largest subset of one
with the smallest of the other, until one is left.

Groups are spread over Spark partitions by a hash and differenced there, which
leaves one partial partition each. Those go up a tree: a task differences `fan_in` of them,
`fan_in * shards` numbers, into one, until one is left; the subsets' places are then
joined down the tree. Nothing is collected to the driver.

Defined results: null texts are one group of 0 bytes, as are empty ones; repeated
rows are in one group; null ids are dealt too; with fewer groups than shards some
shards stay empty; columns of other names are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, hinted, ship


def difference(partial: list[tuple[list[int], list]], shards: int) -> tuple[list[int], list]:
    """Combine partial partitions (ascending sums, contents) into one.

    Contents are None, a leaf, or a pair of contents. Of equal spreads the earlier one is first.
    """
    heap = [(sums[0] - sums[-1], i, sums, held) for i, (sums, held) in enumerate(partial)]
    heapq.heapify(heap)
    nth = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heap[0]
        both = [(s + t, u if v is None else v if u is None else (u, v)) for s, t, u, v in zip(a, reversed(b), x, reversed(y))]
        both.sort(key=_sum)
        sums, held = [s for s, _ in both], [h for _, h in both]
        heapq.heapreplace(heap, (sums[0] - sums[-1], nth, sums, held))
        nth += 1
    if not heap:
        return [0] * shards, [None] * shards
    return heap[0][2], heap[0][3]


def _sum(x: tuple[int, object]) -> int:
    return x[0]


def leaves(held: object) -> Iterator[object]:
    """The leaves of one subset's contents; leaves are lists."""
    stack = [held]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            yield x


def single(size: int, leaf: list, shards: int) -> tuple[list[int], list]:
    return [0] * (shards - 1) + [size], [None] * (shards - 1) + [leaf]


def _local(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for part, g, n in zip(b["part"].to_pylist(), b["g"].to_pylist(), b["bytes"].to_pylist()):
                parts.setdefault(part, []).append((n, g))
        for part in sorted(parts):
            rows = sorted(parts.pop(part), reverse=True)
            sums, held = difference([single(n, [g], shards) for n, g in rows], shards)
            for slot in range(shards):
                g = [x[0] for x in leaves(held[slot])]
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([part] * len(g), pa.int32()), pa.array([slot] * len(g), pa.int32()), pa.array([sums[slot]] * len(g), pa.int64())], ["g", "part", "slot", "slot_bytes"])

    return run


def _merge(shards: int):
    """Partial partitions (up, part, slot, bytes) of each `up` differenced; of each slot its place (up, up_slot) and that place's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for b in batches:
            for up, part, slot, n in zip(*(b[c].to_pylist() for c in ("up", "part", "slot", "bytes"))):
                own.setdefault(up, {}).setdefault(part, []).append((n, slot))
        for up in sorted(own):
            ready = []
            for part, slots in sorted(own.pop(up).items()):
                slots.sort()
                pad = shards - len(slots)
                ready.append(([0] * pad + [n for n, _ in slots], [None] * pad + [[part, slot] for _, slot in slots]))
            sums, held = difference(ready, shards)
            rows = [(*leaf, up, i, sums[i]) for i in range(shards) for leaf in leaves(held[i])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "slot", "up", "up_slot", "up_bytes"])

    return run


def placed(slots: DataFrame, parts: int, shards: int, fan_in: int) -> DataFrame:
    """(part, slot, shard) of the slots (part, slot, bytes) of so many partial partitions."""
    links, now = [], slots
    while parts > 1:
        ups = -(-parts // fan_in)
        link = cut(now.withColumn("up", (F.col("part") / fan_in).cast("int")).repartition("up").select("up", "part", "slot", "bytes").mapInArrow(_merge(shards), "part int, slot int, up int, up_slot int, up_bytes long"))
        links.append(link)
        now = link.select(F.col("up").alias("part"), F.col("up_slot").alias("slot"), F.col("up_bytes").alias("bytes")).distinct()
        parts = ups
    table = now.select("part", "slot", F.col("slot").alias("shard"))
    for link in reversed(links):
        above = table.select(F.col("part").alias("up"), F.col("slot").alias("up_slot"), "shard")
        table = cut(link.join(above, ["up", "up_slot"]).select("part", "slot", "shard"))
    return table


def sharded(docs: DataFrame, shards: int = 16, group: Column | None = None, id_col: str = "doc_id", text_col: str = "text", groups_per_part: int = 50_000, fan_in: int = 64) -> DataFrame:
    """(doc_id, group_id, bytes, shard) of every row; group_id is a hash of the group's key."""
    if shards < 1 or fan_in < 2:
        raise ValueError("shards must be positive and fan_in at least 2")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col) if group is None else group).alias("group_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"))
    groups = cut(rows.groupBy(F.col("group_id").alias("g")).agg(F.sum("bytes").alias("bytes")))
    parts = max(1, -(-groups.count() // groups_per_part))
    spread = groups.withColumn("part", F.pmod(F.hash("g"), F.lit(parts)).cast("int")).repartition(parts, "part")
    slots = cut(spread.select("part", "g", "bytes").mapInArrow(_local(shards), "g long, part int, slot int, slot_bytes long"))
    table = placed(slots.select("part", "slot", F.col("slot_bytes").alias("bytes")).distinct(), parts, shards, fan_in)
    dealt = slots.join(hinted(table), ["part", "slot"]).select(F.col("g").alias("group_id"), "shard")
    return rows.join(dealt, "group_id").select("doc_id", "group_id", "bytes", "shard")
