"""Continuous ingest: a stream of changes folded into a table of current rows.

Each micro-batch is reduced to the last change of every key and merged into a new
Parquet version, which a small pointer file then names; the version before the last one
is removed. The pointer carries the
batch number, so a batch that is run again after a failure changes nothing. Changes
that come late lose against newer ones by their order column, in whatever batch.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..sources.changelog import last_wins


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """All keys with their last change, deletions included; None before the first batch."""
    pointer = f"{path}/current.json"
    if not files.exists(spark, pointer):
        return None
    return spark.read.parquet(f"{path}/{json.loads(files.read_text(spark, pointer))['version']}")


def merge(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    spark = batch.sparkSession
    pointer = f"{path}/current.json"
    known = json.loads(files.read_text(spark, pointer)) if files.exists(spark, pointer) else {"batch": -1}
    if batch_id <= known["batch"]:
        return
    old = current(spark, path)
    rows = batch if old is None else old.unionByName(batch)
    version = f"v{batch_id}"
    last_wins(rows, keys, order).write.mode("overwrite").parquet(f"{path}/{version}")
    files.write_text(spark, pointer, json.dumps({"version": version, "batch": batch_id, "before": known.get("version")}))
    if known.get("before"):
        files.remove(spark, f"{path}/{known['before']}")


def upserts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], **trigger: object) -> StreamingQuery:
    """Start folding a stream into the table at path."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: merge(batch, n, path, keys, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live(rows: DataFrame, action_col: str = "action", deleting: Sequence[str] = ("delete",)) -> DataFrame:
    """The rows whose last change is no deletion."""
    return rows.where(~F.col(action_col).isin(*deleting))
