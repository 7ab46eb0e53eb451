"""A queryable table of metadata postings (field, key, id, num).

Every member of the metadata is posted under a key that carries its type: s: for
strings, i: for whole numbers, f: for others (six decimals), b: for booleans and ?:
for anything else, as JSON. Numbers are posted with their value as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_key(value: Column) -> Column:
    """The key of a variant."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "bigint").cast("string")
    number = F.format_string("%.6f", F.try_variant_get(value, "$", "double"))
    return (
        F.when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(value, "$", "string")))
        .when(kind == "BIGINT", F.concat(F.lit("i:"), whole))
        .when(_fraction(kind), F.concat(F.lit("f:"), number))
        .when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(value, "$", "string")))
        .otherwise(F.concat(F.lit("?:"), F.to_json(value)))
    )


def _fraction(kind: Column) -> Column:
    return kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def postings(docs: DataFrame, id_col: str = "id", metadata_col: str = "metadata") -> DataFrame:
    """(field, key, id, num) of JSON metadata; metadata that is no object has none."""
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.from_json(F.col(metadata_col), "map<string, variant>")).alias("field", "value"))
    kind = F.schema_of_variant("value")
    num = F.when((kind == "BIGINT") | _fraction(kind), F.try_variant_get("value", "$", "double"))
    return rows.select("field", value_key(F.col("value")).alias("key"), "id", num.alias("num"))


def literal_key(value: Any) -> str:
    match value:
        case bool():
            return f"b:{str(value).lower()}"
        case int():
            return f"i:{value}"
        case float():
            return f"f:{value:.6f}"
        case str():
            return f"s:{value}"
        case _:
            import json

            return "?:" + json.dumps(value, separators=(",", ":"), sort_keys=True)


def match(index: DataFrame, field: str, value: Any) -> DataFrame:
    """Ids whose field has the value and its type."""
    return index.where((F.col("field") == field) & (F.col("key") == literal_key(value))).select("id").distinct()


def match_in(index: DataFrame, field: str, values: Sequence[Any]) -> DataFrame:
    return index.where((F.col("field") == field) & F.col("key").isin([literal_key(v) for v in values])).select("id").distinct()


def match_range(index: DataFrame, field: str, low: float, high: float) -> DataFrame:
    """Ids whose number lies within both bounds, which are included."""
    return index.where((F.col("field") == field) & F.col("num").between(float(low), float(high))).select("id").distinct()


def all_ids(index: DataFrame) -> DataFrame:
    return index.select("id").distinct()


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti").select("field", "key", "id", "num")


def size(index: DataFrame) -> int:
    return index.count()
