"""SimHash near-duplicate groups by an LSH forest.

Every text gets two 64-bit SimHashes: `lex` over its words, each with weight
1 + floor(log2(its count)), and `seq` over its word pairs. An LSH forest of
`tries` tries, a number that doesn't depend on the input, indexes `lex`: trie t holds
the signatures with their bits in the order of a random permutation, so that similar
signatures share a long prefix in some trie. A pair at the distance limit is found in
a subtree of prefix p with a known probability; the search begins at the longest prefix
and climbs to shorter ones until all tries together reach the target recall
(`climb`). The subtrees at that prefix are the tasks' units. A subtree that is still
crowded is not compared pair by pair: within its task it becomes a forest of its own over
the bits that are left, whose prefix is the longer the denser the subtree is and
which has as many tries as it takes to lose `LOSS` of its pairs at most; they cost memory
of that task only, since nothing more is shuffled. What no prefix splits is compared whole.
Candidates are verified by exact Hamming distances of both signatures, and the
connected components of the verified pairs are the groups.

With `similarity` (the default) the search is wider: it is planned for pairs at `WIDE_PLAN`
bits of `lex`, and pairs within `WIDE` and `WIDE_SEQ` bits that the limits of the signatures
don't join are joined where the texts' sets of word trigrams have at least that exact
Jaccard similarity. Texts with equal signatures are stood for by one of them. Of the
candidates those are compared whose numbers of trigrams allow that similarity and whose
SimHashes `tri` of the trigrams are within `WIDE_TRI` bits.

Texts with equal signatures are one node, so thousands of exact copies cost a
line each. A subtree's pairs are compared in blocks inside numpy and leave it as
a spanning forest, so that a family of m near copies yields m-1 edges a trie,
and no candidate is dropped.

Defined results: a null, empty or wordless text has no signature and belongs to
no group; repeated rows are copies of one another; a null doc_id takes part in
a group (as null) and the group is named by its smallest doc_id, null only if it
has none. Columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fresh, hinted, ship
from . import _text as T

#: Bits of lex, seq and tri up to which texts are compared, and bits of lex for which the forest is planned.
WIDE, WIDE_SEQ, WIDE_TRI, WIDE_PLAN = 12, 20, 26, 10
#: Tries; share of the pairs at the limit that the forest within a crowded subtree may lose; rows that it compares directly.
TRIES, LOSS, CROWD = 24, 0.05, 512
#: Rows of a run up to which its pairs are listed side by side with other runs', and rows of a tile of pairs beyond.
FEW, TILE = 16, 64
#: Jaccard similarity of word trigrams from which texts are near copies.
SIMILARITY = 0.6


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lex, seq and the number of words of each (lower-cased) text."""
    lex, seq, count = [], [], []
    for s in T.slices(text):
        w = T.words(s)
        row = T.row_of(w.ptr)
        if len(row):
            order = np.lexsort((w.h, row))
            h, r = w.h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            weight = np.frexp(np.diff(np.append(at, len(h))))[1]
            voters, owner = np.repeat(h[at], weight), np.repeat(r[at], weight)
            lex.append(T.simhash(w, voters, np.searchsorted(owner, np.arange(s.rows + 1))))
            pairs, begin = T.ngrams(w, 2)
            seq.append(T.simhash(w, pairs, np.searchsorted(begin, w.ptr)))
        else:
            lex.append(np.zeros(s.rows, np.uint64))
            seq.append(np.zeros(s.rows, np.uint64))
        count.append(np.diff(w.ptr))
    if not lex:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64)
    return np.concatenate(lex), np.concatenate(seq), np.concatenate(count)


def trigrams(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word trigrams, and the borders of rows."""
    w = T.words(s)
    h, begin = T.ngrams(w, 3)
    row = T.row_of(w.ptr)[begin]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(s.rows + 1))


def _sign_batches(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lex, seq, n = signatures(b.column(2))
            columns, names = [b.column(0), b.column(1), pa.array(lex.view(np.int64)), pa.array(seq.view(np.int64))], ["doc_id", "th", "lex", "seq"]
            if wide:
                parts = [trigrams(s) for s in T.slices(b.column(2))]
                tri = np.concatenate([T.simhash(None, h, ptr) for h, ptr in parts] or [np.zeros(0, np.uint64)])
                size = np.concatenate([np.diff(ptr) for _, ptr in parts] or [np.zeros(0, np.int64)])
                columns += [pa.array(tri.view(np.int64)), pa.array(size.astype(np.int32))]
                names += ["tri", "size"]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(n > 0))

    return run


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """(doc_id, th, lex, seq) of every text that has a word, if wide with (tri, size) of its trigrams; th is a hash of the text as it is."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.lower(F.col(text_col)).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    return rows.mapInArrow(_sign_batches(wide), "doc_id long, th long, lex long, seq long" + (", tri long, size int" if wide else ""))


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = []
        for s in T.slices(b.column(1)):
            h, ptr = trigrams(s)
            sets += [x.astype(np.uint32).view(np.int32) for x in np.split(h, ptr[1:-1])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "sh"])


def agreement(depth: int, distance: int, bits: int = 64) -> float:
    """The probability that signatures of so many bits that differ in `distance` agree on a random prefix."""
    return math.prod(max(0, bits - distance - i) / (bits - i) for i in range(depth))


def climb(distance: int, recall: float, tries: int) -> int:
    """The longest prefix at which the tries together find a pair at the distance limit with the target recall."""
    depth = 64
    while depth and 1 - (1 - agreement(depth, distance) * (1 - LOSS)) ** tries < recall:
        depth -= 1
    return depth


def inner_plan(rows: int, distance: int, used: int, crowd: int = CROWD) -> tuple[int, int]:
    """Prefix over the bits that are left, and number of tries, of the forest within a crowded subtree."""
    bits = 64 - used
    depth = min(bits - distance, max(1, math.ceil(math.log2(rows / crowd)))) if bits > distance else 0
    agree = agreement(depth, distance, bits)
    return depth, 1 if agree >= 1 else math.ceil(math.log(LOSS) / math.log(1 - agree))


@lru_cache(4096)
def permutations(tries: int, seed: int, top: int = 64) -> list[np.ndarray]:
    """For each trie a table [byte number, byte value] of permuted bits, to be or-ed; only the `top` bits change places."""
    out = []
    for t in range(tries):
        to = np.append(np.arange(64 - top), 64 - top + np.random.default_rng([seed, t]).permutation(top))
        table = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                table[byte, has] |= np.uint64(1) << np.uint64(to[8 * byte + bit])
        out.append(table)
    return out


def permuted(sig: np.ndarray, table: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)
    out = table[0][parts[:, 0]]
    for byte in range(1, 8):
        out |= table[byte][parts[:, byte]]
    return out


def _borders(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run."""
    begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(run)))


def side_by_side(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each run, those one apart, two apart and so on; the work is the number of pairs."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    end = np.cumsum(size)
    within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
    row, left = np.repeat(begin, size) + within, np.repeat(size, size) - within
    for step in range(1, int(size[0]) if len(size) else 1):
        a = row[: end[np.searchsorted(-size, -step) - 1]]
        a = a[left[: len(a)] > step]
        yield a, a + step


def joined(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each of n rows, and which of the edges make up a spanning forest."""
    label, keep = np.arange(n), []
    at = np.arange(len(a))
    while True:
        x, y = label[a[at]], label[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return label, np.concatenate(keep) if keep else at
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        keep.append(at[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]  # always to a smaller one, so there are no cycles
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def within(key: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (the first one smaller) of keys that differ in at most `limit` bits, by tiles of all pairs."""
    m = len(key)
    for at in range(0, m, TILE):
        own, rest = key[at : at + TILE], key[at:]
        hit = np.flatnonzero(np.bitwise_count(own[:, None] ^ rest[None, :]).ravel() <= limit)
        a, b = hit // len(rest), hit % len(rest)
        later = a < b
        yield a[later] + at, b[later] + at


def near_pairs(key: np.ndarray, seq: np.ndarray, begin: np.ndarray, size: np.ndarray, limit: int, seq_limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the pairs of rows of each run within both limits; a run's pairs are in one block."""
    few = size <= FEW
    left, right, held = [], [], 0
    for a, b in side_by_side(begin[few], size[few]):
        hit = np.bitwise_count(key[a] ^ key[b]) <= limit
        a, b = a[hit], b[hit]
        hit = np.bitwise_count(seq[a] ^ seq[b]) <= seq_limit
        left.append(a[hit])
        right.append(b[hit])
    if left:
        yield np.concatenate(left), np.concatenate(right)
    left, right = [], []
    for at, m in zip(begin[~few].tolist(), size[~few].tolist()):
        for a, b in within(key[at : at + m], limit):
            if len(a):
                a, b = a + at, b + at
                hit = np.bitwise_count(seq[a] ^ seq[b]) <= seq_limit
                left.append(a[hit])
                right.append(b[hit])
                held += len(left[-1])
        if held > 200_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of some edges, ascending, the component of each, and which of the edges make up a spanning forest."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, keep = joined(len(rows), at[: len(a)], at[len(a) :])
    return rows, label, keep


def edges_of(key: np.ndarray, seq: np.ndarray, run: np.ndarray, distance: int, seq_distance: int, wide: bool) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Verified edges (sure, a, b) among sorted rows that share a run number: a spanning forest of each run's pairs within both distances and, if wide, blocks of all pairs within the wide limits but for those that it connects."""
    begin, size = _borders(run)
    small = size <= CROWD
    limits = (max(distance, WIDE), max(seq_distance, WIDE_SEQ)) if wide else (distance, seq_distance)
    for a, b in near_pairs(key, seq, begin[small], size[small], *limits):
        lex, of_pairs = np.bitwise_count(key[a] ^ key[b]), np.bitwise_count(seq[a] ^ seq[b])
        sure = (lex <= distance) & (of_pairs <= seq_distance)
        x, y = a[sure], b[sure]
        rows, label, keep = forest_of(x, y)
        yield True, x[keep], y[keep]
        if wide:
            rest = ~sure & (lex <= WIDE) & (of_pairs <= WIDE_SEQ)
            a, b = a[rest], b[rest]
            if len(rows) and len(a):
                i, j = np.minimum(np.searchsorted(rows, a), len(rows) - 1), np.minimum(np.searchsorted(rows, b), len(rows) - 1)
                apart = (rows[i] != a) | (rows[j] != b) | (label[i] != label[j])
                a, b = a[apart], b[apart]
            yield False, a, b
    for at, m in zip(begin[~small].tolist(), size[~small].tolist()):
        k, q = key[at : at + m], seq[at : at + m]
        label, held = np.arange(m), [np.zeros((2, 0), np.int64)]
        for a, b in within(k, limits[0]):  # tile by tile, without what is connected by then
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            lex, of_pairs = np.bitwise_count(k[a] ^ k[b]), np.bitwise_count(q[a] ^ q[b])
            sure = (lex <= distance) & (of_pairs <= seq_distance)
            if sure.any():
                x, y = a[sure], b[sure]
                rows, own, keep = forest_of(label[x], label[y])
                yield True, at + x[keep], at + y[keep]
                to = np.arange(m)
                to[rows] = rows[own]
                label = to[label]
                if (label == label[0]).all():
                    held.clear()
                    break
            if wide:
                rest = ~sure & (lex <= WIDE) & (of_pairs <= WIDE_SEQ)
                held.append(np.stack([a[rest], b[rest]]))
                if sum(x.shape[1] for x in held) > 200_000:
                    both = np.concatenate(held, axis=1)
                    both = both[:, label[both[0]] != label[both[1]]]
                    held = [both]
                    if both.shape[1] > 100_000:
                        yield False, at + both[0], at + both[1]
                        held = [np.zeros((2, 0), np.int64)]
        if wide and held:
            both = np.concatenate(held, axis=1)
            both = both[:, label[both[0]] != label[both[1]]]
            yield False, at + both[0], at + both[1]


def close_pairs(key: np.ndarray, seq: np.ndarray, run: np.ndarray, distance: int, seq_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each run's pairs within both distances."""
    none = np.zeros(0, np.int64)
    left, right = zip((none, none), *((a, b) for _, a, b in edges_of(key, seq, run, distance, seq_distance, False)))
    return np.concatenate(left), np.concatenate(right)


def runs_of(key: np.ndarray, depth: int) -> np.ndarray:
    """A number for each prefix of sorted keys."""
    if depth == 0 or not len(key):
        return np.zeros(len(key), np.int64)
    prefix = key >> np.uint64(64 - depth)
    return np.cumsum(np.append(0, prefix[1:] != prefix[:-1]))


def subtrees(key: np.ndarray, depth: int, distance: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their run numbers, sets of rows to be compared: the subtrees of a prefix, and in place of crowded ones those of their own forests."""
    order = np.argsort(key, kind="stable")
    run = runs_of(key[order], depth)
    size = np.bincount(run, minlength=1)
    small = size[run] <= CROWD
    yield order[small], run[small]
    border = np.append(0, np.cumsum(size))
    for one in np.flatnonzero(size > CROWD):
        rows = order[border[one] : border[one + 1]]
        below, tries = inner_plan(len(rows), distance, depth)
        for t in range(tries):
            own = permuted(key[rows] << np.uint64(depth), permutations(1, seed * 1000 + t, 64 - depth)[0])
            again = np.argsort(own, kind="stable")
            yield rows[again], runs_of(own[again], below)


def _search(depth: int, distance: int, seq_distance: int, wide: bool, seed: int):
    plan = WIDE_PLAN if wide else distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        trie = t["trie"].to_numpy()
        key = t["key"].to_numpy().astype(np.int64).view(np.uint64)
        seq = t["seq"].to_numpy().astype(np.int64).view(np.uint64)
        node = t["node"].to_numpy()
        for one in np.unique(trie):
            rows = np.flatnonzero(trie == one)
            for pick, runs in subtrees(key[rows], depth, plan, seed):
                at = rows[pick]
                own = key[at], seq[at], runs
                ids = node[at]
                for sure, a, b in edges_of(*own, distance, seq_distance, wide):
                    x, y = ids[a], ids[b]
                    keep = x != y
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(np.full(keep.sum(), sure))], ["a", "b", "sure"])

    return run


def _plant(tables: list[np.ndarray], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lex = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for trie, table in enumerate(tables):
                key = permuted(lex, table)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(lex), trie, np.int32)), pa.array((key >> np.uint64(64 - depth)).astype(np.int64)), pa.array(key.view(np.int64)), b.column(2)],
                    ["node", "trie", "bucket", "key", "seq"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label is its component's smallest node.

    Alternates between linking every larger neighbour and every smaller neighbour
    to the smallest one, until nothing changes, which the number of edges and two sums over
    them tell. Each round is cut by a checkpoint.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())

    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.select(F.col("b").alias("n"), F.col("a").alias("o"))
        least = down.groupBy("n").agg(F.min("o").alias("m"))
        small = down.join(least, "n").select(F.col("m").alias("a"), F.col("o").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).where("a <> b").distinct()
        edges, before = cut(small), now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' word trigrams have at least that Jaccard similarity."""
    few = nodes.select("node", "tri", "size")
    pairs = pairs.join(few.toDF("a", "t", "n"), "a").join(few.toDF("b", "u", "m"), "b")
    pairs = cut(pairs.where((F.bit_count(F.col("t").bitwiseXOR(F.col("u"))) <= WIDE_TRI) & (F.least("n", "m") >= similarity * F.greatest("n", "m"))).select("a", "b"))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "th"), "node"))
    rows = docs.select(F.xxhash64(text_col).alias("th"), F.lower(F.col(text_col)).alias("t")).join(hinted(wanted), "th").dropDuplicates(["node"]).select("node", "t")
    sets = cut(rows.mapInArrow(_shingle_batches, "node long, sh array<int>"))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where((common > 0) & (common >= similarity * (F.size("x") + F.size("y") - common))).select("a", "b")


def grouped(sigs: DataFrame, distance: int = 7, seq_distance: int = 16, recall: float = 0.9, tries: int = TRIES, seed: int = 7, similarity: float | None = SIMILARITY, docs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The rows of signed() that have a near duplicate, with their component as `label`. sigs must be materialised; for `similarity` it is wide, and docs is read again."""
    sigs = sigs.withColumn("node", F.xxhash64("lex", "seq"))
    wide = similarity is not None
    least = F.min(F.struct("th", "tri", "size"))
    rep = [least[c].alias(c) for c in ("th", "tri", "size")] if wide else []
    nodes = cut(sigs.groupBy("node").agg(F.first("lex").alias("lex"), F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"), *rep))
    depth = climb(WIDE_PLAN if wide else distance, recall, tries)
    tables = permutations(tries, seed)
    planted = nodes.select("node", "lex", "seq").mapInArrow(_plant(tables, depth), "node long, trie int, bucket long, key long, seq long")
    edges = planted.repartition("trie", "bucket").mapInArrow(_search(depth, distance, seq_distance, wide, seed), "a long, b long, sure boolean")
    if wide:
        edges = cut(edges.groupBy("a", "b").agg(F.max("sure").alias("sure")))
        edges = edges.where("sure").select("a", "b").unionByName(similar(edges.where("not sure").select("a", "b"), nodes, docs, text_col, similarity))
    label = components(edges.select("a", "b"))
    alone = nodes.where("n > 1").join(label, "node", "left_anti").select("node", F.col("node").alias("label"))
    label = cut(label.unionByName(alone))
    return sigs.join(hinted(label), "node").select("doc_id", "th", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, group_id, group_size) of every document that has a near duplicate; group_id is the group's smallest doc_id."""
    rows = cut(grouped(cut(signed(docs, id_col, text_col, options.get("similarity", SIMILARITY) is not None)), docs=docs, text_col=text_col, **options))
    groups = rows.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "label").select("doc_id", "group_id", "group_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (nulls last), then of the smallest text hash.

    Rows without a word are kept. All columns are returned as they are.
    """
    rows = cut(grouped(cut(signed(docs, id_col, text_col, options.get("similarity", SIMILARITY) is not None)), docs=docs, text_col=text_col, **options))
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("th"))
    best = rows.groupBy("label").agg(F.min(order).alias("best"))
    marks = rows.join(best, "label").groupBy("doc_id", "th").agg(F.first(order == F.col("best")).alias("kept"), F.count(F.lit(1)).alias("n"))
    key, d, t = fresh("__row", docs), fresh("__id", docs), fresh("__hash", docs)
    marks = cut(marks.where("not kept or n > 1").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("kept").alias(fresh("__kept", docs))))
    kept = marks.columns[2]
    keyed = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t")))
    same = keyed[key]["d"].eqNullSafe(F.col(d)) & (keyed[key]["t"] == F.col(t))
    rest = keyed.join(hinted(marks), same, "left_anti")
    again = marks.where(F.col(kept))
    if again.isEmpty():
        return rest.drop(key)
    once = keyed.join(hinted(again), same, "left_semi").dropDuplicates([key])
    return rest.unionByName(once).drop(key)
