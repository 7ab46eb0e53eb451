"""Newline-delimited JSON documents: {"id", "vector", "metadata"} on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_lines(docs: DataFrame, id_col: str = "id", vector_col: str = "vector", metadata_col: str | None = "metadata") -> DataFrame:
    """(line): one JSON object for each document; missing metadata is {}."""
    meta = F.lit("{}") if metadata_col is None else F.coalesce(F.col(metadata_col), F.lit("{}"))
    return docs.select(
        F.concat(F.lit('{"id":'), _quoted(F.col(id_col).cast("string")), F.lit(',"vector":'), F.to_json(F.col(vector_col).cast("array<double>")), F.lit(',"metadata":'), meta, F.lit("}")).alias("line")
    )


def _quoted(text):
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def export(docs: DataFrame, path: str, **columns: str | None) -> None:
    to_lines(docs, **columns).write.mode("overwrite").text(path)


def parse(lines: DataFrame) -> DataFrame:
    """(n, id, vector, metadata, error) of (n, line), for lines that are neither empty nor begin with # or /."""
    kept = lines.where((F.col("line") != "") & ~F.substring("line", 1, 1).isin("#", "/"))
    v = F.try_parse_json("line")
    doc = kept.select("n", v.alias("v"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    doc = doc.select("n", at("$.id", "string").alias("id"), at("$.vector", "array<double>").alias("vector"), F.coalesce(F.to_json(at("$.metadata", "variant")), F.lit("{}")).alias("metadata"), F.col("v").isNull().alias("_bad"))
    return doc.select("n", "id", "vector", "metadata", F.when(F.col("_bad"), "no JSON").when(F.col("id").isNull() | (F.col("id") == ""), "no id").when(F.col("vector").isNull(), "no vector").alias("error"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, metadata) of all documents of a file or folder; ValueError with the first bad line's number, and then nothing is read.

    Lines are read in parallel. Only when one is bad is its file read again, as one
    piece, to number its lines.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    docs = parse(lines)
    if docs.where("error is not null").isEmpty():
        return docs.select("id", "vector", "metadata")
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    bad = parse(whole.select((F.col("n") + 1).alias("n"), "line")).where("error is not null").orderBy("n").select("n", "error").first()
    raise ValueError(f"line {bad['n']}: {bad['error']}")
