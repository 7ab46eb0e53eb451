"""Inverted-file search: vectors in lists by their nearest centroid, of which a query probes a few.

Distances to centroids are Euclidean under every metric, and ties go to the smaller
centroid number. Stored lists are partitioned by `cid`, so that a probe prunes files.

There are about as many lists as the square root of the number of rows, trained on a
bounded sample (`TRAIN_ROWS`, by a hash of the vector); every row is in a list. Batch search
packs the vectors of a list, and the queries that probe it, into blocks; blocks of one
list meet and a matrix product scores a whole pair of them. Rows are spread by ranges of
(list, id), so that a list that holds most rows is cut over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..session import ship
from . import search as exact

N_PROBE, MAX_ITER, SEED = 5, 25, 42
FEWEST, MOST, TRAIN_ROWS, SPARSE = 16, 65_536, 1_000_000, 8


def list_count(rows: int) -> int:
    """How many lists so many rows get."""
    return max(1, min(MOST, rows, max(FEWEST, math.isqrt(max(rows - 1, 0)) + 1)))


def nearest(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each vector, nearest first."""
    distance = np.round(-exact.pair_scores(vectors, centroids, Metric.L2), exact.DIGITS)
    return distance.argmin(axis=1)[:, None] if n == 1 else np.argsort(distance, axis=1, kind="stable")[:, :n]


def _assigned(centroids: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                near = nearest(centroids, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), n)
                cids = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cids], ["id", "v", "cids"])

    return run


def _near(docs: DataFrame, centroids: np.ndarray, n: int, id_col: str, vector_col: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == centroids.shape[1])
    return rows.mapInArrow(_assigned(centroids, n), "id long, v array<double>, cids array<int>")


def assign(docs: DataFrame, centroids: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, v, cid); vectors of another length than the centroids' are left out."""
    return _near(docs, centroids, 1, id_col, vector_col).select("id", "v", F.col("cids")[0].alias("cid"))


def lloyd_step(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cid, pos, value): the means of the lists by dimension; an empty list keeps its centroid."""
    spark = assigned.sparkSession
    old = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(centroids) for j, x in enumerate(row)], "cid int, pos int, old double")
    means = assigned.select("cid", F.posexplode("v").alias("pos", "x")).groupBy("cid", "pos").agg(F.avg("x").alias("mean"))
    return old.join(means, ["cid", "pos"], "left").select("cid", "pos", F.coalesce("mean", "old").alias("value"))


def train(docs: DataFrame, k: int | None = None, vector_col: str = "vector", max_iter: int = MAX_ITER, seed: int = SEED, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Centroids by distributed k-means over about train_rows rows at most; there are at most as many as rows, list_count of them by default."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    given = docs.select(F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    total = given.count()
    if total == 0:
        raise ValueError("no vectors to train on")
    if total > train_rows:
        given = given.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * train_rows / total))
    rows = given.select(array_to_vector("v").alias("features"))
    if total == 1:
        return np.array([rows.first()["features"].toArray()])
    fitted = KMeans(k=min(k or list_count(total), total), maxIter=max_iter, seed=seed, initMode="k-means||").fit(rows)
    return np.array(fitted.clusterCenters())


def probes(centroids: np.ndarray, query: Sequence[float], n_probe: int = N_PROBE) -> list[int]:
    return [int(c) for c in nearest(centroids, np.array([query], np.float64), n_probe)[0]]


def measured_probes(docs: DataFrame, centroids: np.ndarray, metric: str | Metric = "cosine", k: int = 10, wanted: float = 0.92, sample: int = 200, id_col: str = "id", vector_col: str = "vector", asked: DataFrame | None = None, least: int = N_PROBE) -> int:
    """How many lists hold that share of the k true neighbours (but for itself) of some rows, `least` at least.

    The rows are those of `asked` (id, vector), else `sample` ones by a hash of the id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.size("vector") == centroids.shape[1])
    if asked is None:
        asked = rows.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(sample)
    true = exact.search_batch(asked, rows, k + 1, metric).where("query_id <> id").select("query_id", "id")
    order = _near(asked, centroids, len(centroids), "id", "vector").select(F.col("id").alias("query_id"), "cids")
    place = true.join(assign(rows, centroids).select("id", "cid"), "id").join(order, "query_id").select(F.array_position("cids", F.col("cid")).alias("p"))
    seen = {r["p"]: r["count"] for r in place.groupBy("p").count().collect()}
    left = math.ceil(wanted * sum(seen.values()))
    for p in sorted(seen):
        left -= seen[p]
        if left <= 0:
            return max(least, p)
    return len(centroids)


def search(lists: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int = 10, n_probe: int = N_PROBE, metric: str | Metric = "cosine", where: Column | None = None) -> DataFrame:
    """(rank, id, score) among the probed lists; lists has (id, v, cid) and whatever `where` reads."""
    probed = lists.where(F.col("cid").isin(probes(centroids, query, n_probe)))
    return exact.search(probed, query, k, metric, where, "id", "v")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one list, packed by up to BLOCK rows; rows come ordered by list."""
    for b in batches:
        cid, ids = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
        v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1) if len(cid) else None
        border = np.append(np.flatnonzero(np.append(True, cid[1:] != cid[:-1])), len(cid)) if len(cid) else [0]
        at = [(x, min(x + exact.BLOCK, z)) for a, z in zip(border[:-1], border[1:]) for x in range(a, z, exact.BLOCK)]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([cid[a] for a, _ in at], pa.int32()), pa.array([ids[a:z] for a, z in at], pa.list_(pa.int64())), pa.array([v[a:z].tobytes() for a, z in at], pa.binary())], ["cid", "ids", "m"])


def _blocks(rows: DataFrame) -> DataFrame:
    """(cid, ids, m) of (id, v, cid)."""
    return rows.repartitionByRange("cid", "id").sortWithinPartitions("cid", "id").mapInArrow(_packed, "cid int, ids array<long>, m binary")


def _probe_bits(centroids: np.ndarray, n: int):
    def run(v: np.ndarray) -> np.ndarray:
        probed = np.zeros((len(v), len(centroids)), bool)
        np.put_along_axis(probed, nearest(centroids, v, n), True, 1)
        return np.packbits(probed, axis=1, bitorder="little")

    return run


def search_batch(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int = 10, n_probe: int = N_PROBE, metric: str | Metric = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): every row of queries against its probed lists, block by block.

    Up to SPARSE probes a query is sent to each of its lists. Beyond that it isn't copied: blocks of
    queries carry the bits of their probes and meet all blocks, and the pairs that reach the best k are checked.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if n_probe > SPARSE:
        size = centroids.shape[1]
        q = exact.packs(exact.plain(queries, id_col, vector_col).where(F.size("v") == size), exact.ASKED, _probe_bits(centroids, n_probe), queries.sparkSession.sparkContext.defaultParallelism)
        d = exact.packs(lists.select("id", "v", F.col("cid").cast("int").alias("cid")).where(F.size("v") == size), exact.PART)
        return exact.best_per_query(exact.met(q, d, k, Metric.parse(metric), len(centroids)), k)
    probing = _near(queries, centroids, n_probe, id_col, vector_col).where("id is not null").select("id", "v", F.explode("cids").alias("cid"))
    q, d = _blocks(probing).toDF("cid", "q_ids", "q"), _blocks(lists.select("id", "v", "cid").where("id is not null")).toDF("cid", "d_ids", "d")
    pairs = q.join(d, "cid").select("q_ids", "q", "d_ids", "d")
    return exact.best_per_query(pairs.mapInArrow(exact._compare(k, Metric.parse(metric)), "query_id long, id long, score double"), k)
