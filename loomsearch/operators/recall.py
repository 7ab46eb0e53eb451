"""How much of the exact result an approximate one has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, found, recall) over all queries of exact; 1.0 if nothing is wanted."""
    hit = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    out = hit.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("found") / F.col("wanted")))
