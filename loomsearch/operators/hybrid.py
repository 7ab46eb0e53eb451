"""Vector and text search fused, by weights or by reciprocal ranks.

Vector scores are clamped at 0 and scaled to 0..1 by the smallest and largest of
the collection (all 1 where these are equal, as under the Euclidean metric, whose
scores are never positive); text scores are scaled among the text hits; what is
absent counts 0. Weights alpha >= 0 give alpha * vector + (1 - alpha) * text; a
negative alpha asks for reciprocal rank fusion, the sum of 1 / (60 + rank), with
vector ranks of the unclamped scores. A filter acts after scaling and ranking.

Ranks over the whole collection need one global order; Spark sorts it by ranges and
the rank is the range's offset plus the place in it, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, score, vector
from ..session import cut
from . import bm25
from .search import DIGITS, ranked

RRF = 60


def _scaled(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 1.0).otherwise((x - low) / (high - low))


def global_rank(df: DataFrame, by: str, tie: str, name: str) -> DataFrame:
    """df with the 1-based rank by falling `by` (rounded), then rising tie."""
    key = F.round(by, DIGITS)
    placed = cut(df.repartitionByRange(F.desc(key), F.asc(tie)).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    offset, at = {}, 0
    for part in sorted(sizes):
        offset[part] = at
        at += sizes[part]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(key), F.asc(tie))).cast("long")
    table = df.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "_part int, _offset long")
    return placed.withColumn("_local", local).join(F.broadcast(table), "_part").withColumn(name, F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")


def search(docs: DataFrame, query: Sequence[float], text_query: str = "", k: int = 10, alpha: float = 0.5, metric: str | Metric = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", text_col: str | None = "text") -> DataFrame:
    """(rank, id, vector_score, text_score, combined_score) of the k best rows.

    Without a text (or a text column) it is plain search and the scores are raw.
    Without a vector all vector scores are equal; rank fusion then leaves them out.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    ok = F.lit(True) if where is None else where
    raw = score(metric, vector(F.col(vector_col)), vector(query)) if len(query) else F.lit(0.0)
    base = docs.where(F.size(vector_col) == len(query)) if len(query) else docs
    rows = base.select(F.col(id_col).alias("id"), raw.alias("raw"), ok.alias("_ok"))
    if text_col is None or not text_query:
        plain = rows.where("_ok").select("id", F.col("raw").alias("vector_score"), F.lit(0.0).alias("text_score"), F.col("raw").alias("combined_score"))
        return ranked(plain, k, F.col("combined_score"), "id").select("rank", "id", "vector_score", "text_score", "combined_score")
    text = bm25.scores(docs, text_query, id_col, text_col).withColumnRenamed("score", "text_raw")
    both = rows.join(text, "id", "left")
    if alpha < 0:
        both = cut(both)
        if len(query):
            both = global_rank(both, "raw", "id", "vector_rank")
        hits = global_rank(both.where("text_raw is not null").select("id", "text_raw"), "text_raw", "id", "text_rank").select("id", "text_rank")
        both = both.join(hits, "id", "left")
    clamped = F.greatest(F.col("raw"), F.lit(0.0))
    known = both.agg(F.min(clamped).alias("v_low"), F.max(clamped).alias("v_high"), F.min("text_raw").alias("t_low"), F.max("text_raw").alias("t_high"))
    both = both.crossJoin(F.broadcast(known)).where("_ok")
    v = _scaled(clamped, F.col("v_low"), F.col("v_high"))
    t = F.when(F.col("text_raw").isNull(), 0.0).otherwise(_scaled(F.col("text_raw"), F.col("t_low"), F.col("t_high")))
    if alpha >= 0:
        combined = F.lit(float(alpha)) * v + F.lit(1.0 - alpha) * t
    else:
        combined = F.coalesce(1.0 / (RRF + F.col("text_rank")), F.lit(0.0))
        if len(query):
            combined = 1.0 / (RRF + F.col("vector_rank")) + combined
    out = both.select("id", v.alias("vector_score"), t.alias("text_score"), combined.alias("combined_score"))
    return ranked(out, k, F.col("combined_score"), "id").select("rank", "id", "vector_score", "text_score", "combined_score")
