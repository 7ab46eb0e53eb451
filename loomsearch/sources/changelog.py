"""A checksummed changelog: JSON lines, one event each, in the order of `seq`.

An event has the members action, collection, crc32, document, documents, id, ids,
metric and schema as far as they apply, with sorted keys. Its checksum is the CRC-32
of the line as it is with the checksum 0; a checksum of 0 is unchecked. Replay takes the lines before the
first bad one, and reduces them without any loop: for each document the last event
that names it counts, unless a later creation, deletion or truncation of its
collection wipes it out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, hinted

ACTIONS = ("create_collection", "upsert", "delete", "batch_upsert", "batch_delete", "delete_collection", "truncate_collection")
DOC = "struct<id: string, vector: array<double>, metadata: string>"
LINE = "action string, collection string, crc32 bigint, document variant, documents array<variant>, id string, ids array<string>, metric string, schema variant"


def encode(event: Mapping[str, Any]) -> str:
    """The line of an event with its checksum."""
    if event.get("action") not in ACTIONS:
        raise ValueError(f"unknown action {event.get('action')!r}")
    blank = json.dumps({**event, "crc32": 0}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    total = zlib.crc32(blank.encode())
    return blank.replace('"crc32":0', f'"crc32":{total}', 1)


def append(spark: SparkSession, path: str, events: Sequence[Mapping[str, Any]], first_seq: int) -> None:
    """Write some events as one new file; seq goes on from first_seq. The commit of the file makes them durable."""
    rows = [(first_seq + i, encode(e)) for i, e in enumerate(events)]
    spark.createDataFrame(rows, "seq long, line string").coalesce(1).write.mode("append").parquet(path)


def checksum_ok(line: Column) -> Column:
    """Whether a line's checksum is right, or 0."""
    stated = F.regexp_extract(line, r'"crc32":(\d+)', 1).try_cast("bigint")
    blank = F.regexp_replace(line, r'^(.*?"crc32":)\d+', "$10")
    return F.coalesce((stated == 0) | (F.crc32(blank.cast("binary")) == stated), F.lit(False))


def valid_prefix(log: DataFrame) -> DataFrame:
    """The non-blank lines of (seq, line) before the first with a bad checksum or that is no JSON object."""
    lines = log.where(F.trim("line") != "")
    bad = lines.where(~checksum_ok(F.col("line")) | F.try_parse_json("line").isNull()).agg(F.min("seq").alias("_bad"))
    return lines.crossJoin(F.broadcast(bad)).where("_bad is null or seq < _bad").select("seq", "line")


def events(log: DataFrame) -> DataFrame:
    """(seq, collection, action, nth, id, doc): one row for each document or id that an event names."""
    e = valid_prefix(log).select("seq", F.from_json("line", LINE).alias("e")).select("seq", "e.*")
    one = F.when(F.col("action") == "upsert", F.array(F.struct(F.try_variant_get("document", "$.id", "string").alias("id"), F.col("document").alias("doc"))))
    many = F.when(F.col("action") == "batch_upsert", F.transform("documents", lambda d: F.struct(F.try_variant_get(d, "$.id", "string").alias("id"), d.alias("doc"))))
    none = F.parse_json(F.lit(None).cast("string"))
    gone = F.when(F.col("action") == "delete", F.array(F.struct(F.col("id").alias("id"), none.alias("doc")))).when(F.col("action") == "batch_delete", F.transform("ids", lambda i: F.struct(i.alias("id"), none.alias("doc"))))
    return e.select("seq", "collection", "action", "metric", F.posexplode_outer(F.coalesce(one, many, gone)).alias("nth", "x")).select("seq", "collection", "action", "metric", "nth", "x.id", "x.doc")


def replay(log: DataFrame) -> DataFrame:
    """(collection, id, vector, metadata): the documents that are there after the whole log."""
    e = events(log)
    wipe, drop = F.col("action").isin("create_collection", "delete_collection", "truncate_collection"), F.col("action").isin("create_collection", "delete_collection")
    marks = e.groupBy("collection").agg(F.max(F.when(wipe, F.col("seq"))).alias("_wiped"), F.max_by("action", F.when(drop, F.col("seq"))).alias("_kind"))
    live = e.where("id is not null").join(hinted(cut(marks)), "collection").where("(_wiped is null or seq > _wiped) and (_kind is null or _kind <> 'delete_collection')")
    last = last_wins(live, ["collection", "id"], ["seq", "nth"])
    return last.where(F.col("action").isin("upsert", "batch_upsert")).select(
        "collection", "id", F.try_variant_get("doc", "$.vector", "array<double>").alias("vector"), F.coalesce(F.to_json(F.try_variant_get("doc", "$.metadata", "variant")), F.lit("{}")).alias("metadata")
    )


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of every key. Only one row of a key leaves each task, so a key of very many rows is no burden."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(last.alias("_last")).select("_last.*")


def delete(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """docs without the ids; unknown ones are ignored."""
    return docs.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti")
