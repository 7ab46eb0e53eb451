"""Exact top-k search. Ranks go by the score rounded to nine digits, then by ascending id.

One query is a projection and a bounded sort (Spark plans TakeOrderedAndProject, so
only k rows of each partition travel). Many queries are compared in blocks: packed
blocks of vectors meet pairwise and a matrix product in numpy scores a whole pair
of blocks. A task keeps the best k of each query over all blocks that it meets (those of a
part of at most `PART` blocks), so that k rows go on for a query and part. Once it has k, a product in
single precision finds the pairs that may be among them, and these few are scored again in double
precision; where it could overflow, or too many are left, the whole pair of blocks is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, score, vector
from ..session import ship

DIGITS = 9
BLOCK = 2048
#: Blocks of documents, and of queries, that a task meets; rows by which the first k are found; error of scaled single-precision scores by dimension.
PART, ASKED, FIRST, MARGIN = 32, 8, 256, 4e-7


def ranked(df: DataFrame, k: int, by: Column, *tie: str | Column) -> DataFrame:
    """The best k rows with their rank, which begins at 1."""
    if k <= 0:
        raise ValueError("k must be positive")
    top = df.withColumn("_key", F.round(by, DIGITS)).orderBy(F.desc("_key"), *tie).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_key"), *tie)).cast("long")).drop("_key")


def search(docs: DataFrame, query: Sequence[float], k: int = 10, metric: str | Metric = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", carry: Sequence[str] = ()) -> DataFrame:
    """(rank, id, score, ...carry) of the k best rows that satisfy `where`; the filter comes first, so k is exact."""
    rows = docs if where is None else docs.where(where)
    one = score(metric, vector(F.col(vector_col)), vector(query))
    found = rows.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), one.alias("score"), *carry)
    return ranked(found, k, F.col("score"), "id").select("rank", "id", "score", *carry)


def search_oversampled(docs: DataFrame, query: Sequence[float], where: Column, k: int = 10, factor: int = 3, metric: str | Metric = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Filter after search: the best factor * k rows are filtered, and only if fewer than k are left the whole table is."""
    one = score(metric, vector(F.col(vector_col)), vector(query))
    marked = docs.select(F.col(id_col).alias("id"), one.alias("score"), where.alias("_ok"))
    near = marked.orderBy(F.desc(F.round("score", DIGITS)), "id").limit(factor * k).where("_ok").select("id", "score")
    if near.count() < k:
        return search(docs, query, k, metric, where, id_col, vector_col)
    return ranked(near, k, F.col("score"), "id").select("rank", "id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            sizes = np.array([len(v) for v in part.column(1).to_pylist()])
            for size in np.unique(sizes):
                own = part.take(pa.array(np.flatnonzero(sizes == size)))
                m = np.array(own.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])


def blocks(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(ids, m): vectors of one length packed by up to BLOCK rows; rows of a null id or vector are left out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(_blocks, "ids array<long>, m binary")


def pair_scores(q: np.ndarray, d: np.ndarray, metric: Metric) -> np.ndarray:
    if metric is Metric.L2:
        square = (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * (q @ d.T)
        out = -np.sqrt(np.maximum(square, 0))
        near = np.argwhere(out > -1e-3)  # cancellation matters there only
        out[near[:, 0], near[:, 1]] = -np.sqrt(((q[near[:, 0]] - d[near[:, 1]]) ** 2).sum(1))
        return out
    s = q @ d.T
    if metric is Metric.COSINE:
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((d * d).sum(1))[None, :]
        s = np.divide(s, size, out=np.zeros_like(s), where=size != 0)
    return s


def best_of_block(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row; ties go to the smaller id."""
    key = -np.round(s, DIGITS)
    if key.shape[1] > k:
        row, at = np.nonzero(key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k])
    else:
        row, at = (x.ravel() for x in np.indices(key.shape))
    order = np.lexsort((ids[at], key[row, at], row))
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep]


def _compare(k: int, metric: Metric):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, d_ids = np.array(b.column(0)[i].as_py()), np.array(b.column(2)[i].as_py())
                q = np.frombuffer(b.column(1)[i].as_py(), np.float64).reshape(len(q_ids), -1)
                d = np.frombuffer(b.column(3)[i].as_py(), np.float64).reshape(len(d_ids), -1)
                if q.shape[1] != d.shape[1]:
                    continue
                s = pair_scores(q, d, metric)
                row, at = best_of_block(s, d_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(d_ids[at]), pa.array(s[row, at])], ["query_id", "id", "score"])

    return run


def _pack(extra: Callable[[np.ndarray], np.ndarray] | None):
    """Rows (id, v) as blocks (ids, m, x); x is what `extra` says of the vectors of one length, or a third column of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    own = part if (sizes == size).all() else part.take(pa.array(np.flatnonzero(sizes == size)))
                    m = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, size)
                    x = extra(m).tobytes() if extra else own.column(2).to_numpy(zero_copy_only=False).tobytes() if own.num_columns > 2 else b""
                    yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([x], pa.binary())], ["ids", "m", "x"])

    return run


def packs(rows: DataFrame, per_part: int, extra: Callable[[np.ndarray], np.ndarray] | None = None, tasks: int = 1) -> DataFrame:
    """(b, ids, m, x): rows (id, v) in numbered blocks, in parts of about so many, and of fewer if not so many tasks have one."""
    ship(rows.sparkSession)
    rows = rows.where("id is not null and v is not null")
    blocks = -(-rows.count() // BLOCK)
    parts = max(-(-blocks // per_part), min(blocks, tasks))
    return rows.mapInArrow(_pack(extra), "ids binary, m binary, x binary").select(F.monotonically_increasing_id().alias("b"), "ids", "m", "x").repartition(max(1, parts))


class Best:
    """The best k of each query of a block so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: Metric):
        self.ids, self.q, self.k, self.metric = ids, q, k, metric
        self.size = np.sqrt((q * q).sum(1))
        self.least = np.full(len(q), -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        new = np.zeros(len(self.q), bool)
        new[row] = True
        old = new[self.row]
        r, i, s = (np.concatenate(x) for x in ((self.row[old], row), (self.id[old], ids), (self.score[old], score)))
        order = np.lexsort((i, -np.round(s, DIGITS), r))
        r, i, s = r[order], i[order], s[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        last = nth == self.k - 1
        self.least[r[last]] = np.round(s[last], DIGITS)
        keep = nth < self.k
        self.row, self.id, self.score = (np.concatenate(x) for x in ((self.row[~old], r[keep]), (self.id[~old], i[keep]), (self.score[~old], s[keep])))

    def scores(self, row: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        for x in range(0, len(row), 1 << 15):
            q, v = self.q[row[x : x + (1 << 15)]], d[at[x : x + (1 << 15)]]
            if self.metric is Metric.L2:
                s = -np.sqrt(((q - v) ** 2).sum(1))
            else:
                s = np.einsum("ij,ij->i", q, v)
                if self.metric is Metric.COSINE:
                    size = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))
                    s = np.divide(s, size, out=np.zeros_like(s), where=size != 0)
            out[x : x + len(s)] = s
        return out

    def maybe(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of rows among which are all that reach the k so far; None if single precision can't tell."""
        size = np.sqrt((d * d).sum(1))
        most = float(max(size.max(initial=0), self.size.max(initial=0)))
        if not 1e-100 < most < 1e100:
            return None
        q, v = self.q, d
        if self.metric is Metric.L2:
            q, v = np.column_stack([2 * q / most, np.full(len(q), -1.0)]), np.column_stack([v / most, (size / most) ** 2])
            far = np.maximum(-self.least + 2 * 10.0**-DIGITS, 0) / most
            wanted = (self.size / most) ** 2 - far * far
        else:
            q = np.divide(q, self.size[:, None], out=np.zeros_like(q), where=self.size[:, None] > 0)
            if self.metric is Metric.COSINE:
                v, wanted = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0), self.least
            else:
                v = v / most
                wanted = np.divide(self.least - 10.0**-DIGITS, self.size * most, out=np.full(len(q), -np.inf), where=self.size * most > 0)
        close = q.astype(np.float32) @ v.astype(np.float32).T
        hit = np.flatnonzero((close >= (wanted - MARGIN * (d.shape[1] + 8)).astype(np.float32)[:, None]).ravel())
        return (hit // len(d), hit % len(d)) if len(hit) < close.size // 8 else None

    def meet(self, d_ids: np.ndarray, d: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        """Compare with a block; may says which pairs of rows count, all by default."""
        first = FIRST if np.isinf(self.least).any() else 0
        for at, end in ((0, first), (first, len(d))):
            ids, v = d_ids[at:end], d[at:end]
            if not len(v):
                continue
            found = None if end == first else self.maybe(v)
            if found is None:
                s = pair_scores(self.q, v, self.metric)
                ok = may(np.arange(len(self.q))[:, None], np.arange(at, at + len(v))[None, :]) if may else np.ones((1, 1), bool)
                row, col = best_of_block(np.where(ok, s, -np.inf), ids, self.k)
                if may:
                    ok = ok[row, col]
                    row, col = row[ok], col[ok]
                self.add(row, ids[col], self.scores(row, v, col))
            else:
                row, col = found
                if may:
                    ok = may(row, col + at)
                    row, col = row[ok], col[ok]
                self.add(row, ids[col], self.scores(row, v, col))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], ["query_id", "id", "score"])


def _meet(k: int, metric: Metric, lists: int):
    """Pairs of blocks (b, ids, m, x of queries, then of documents); with lists, x has the bits of the lists that a query probes, and a document's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Best, np.ndarray]] = {}
        for batch in batches:
            for b, q_ids, q, probed, d_ids, d, own in zip(*(c.to_pylist() for c in batch.columns)):
                if b not in held:
                    while len(held) >= 2 * ASKED:
                        yield held.pop(next(iter(held)))[0].batch()
                    ids = np.frombuffer(q_ids, np.int64)
                    held[b] = Best(ids, np.frombuffer(q, np.float64).reshape(len(ids), -1), k, metric), np.frombuffer(probed, np.uint8).reshape(len(ids), -1) if lists else None
                best, bits = held[b]
                ids = np.frombuffer(d_ids, np.int64)
                v = np.frombuffer(d, np.float64).reshape(len(ids), -1)
                if v.shape[1] != best.q.shape[1]:
                    continue
                cid = np.frombuffer(own, np.int32) if lists else None
                may = (lambda row, col, bits=bits, cid=cid: (bits[row, cid[col] >> 3] >> (cid[col] & 7)) & 1 == 1) if lists else None
                if not (np.isfinite(v).all() and np.isfinite(best.q).all()):  # kept as it is, since Spark ranks NaN first
                    once = Best(best.ids, best.q, k, metric)
                    s = pair_scores(best.q, v, metric)
                    row, col = np.nonzero(may(np.arange(len(s))[:, None], np.arange(len(ids))[None, :])) if lists else best_of_block(s, ids, k)
                    once.row, once.id, once.score = row, ids[col], s[row, col]
                    yield once.batch()
                else:
                    best.meet(ids, v, may)
        for best, _ in held.values():
            yield best.batch()

    return run


def met(q: DataFrame, d: DataFrame, k: int, metric: Metric, lists: int = 0) -> DataFrame:
    """(query_id, id, score): the best k of each query and part of the packs d, and whatever else a task didn't drop."""
    pairs = q.toDF("b", "q_ids", "q", "q_x").crossJoin(d.drop("b").toDF("d_ids", "d", "d_x").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_meet(k, metric, lists), "query_id long, id long, score double")


def plain(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v)."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def search_batch(queries: DataFrame, docs: DataFrame, k: int = 10, metric: str | Metric = "cosine", query_id_col: str = "id", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): the k best rows of docs for every row of queries."""
    if k <= 0:
        raise ValueError("k must be positive")
    q, d = packs(plain(queries, query_id_col, vector_col), ASKED, tasks=queries.sparkSession.sparkContext.defaultParallelism), packs(plain(docs, id_col, vector_col), PART)
    return best_per_query(met(q, d, k, Metric.parse(metric)), k)


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
