"""Metadata filters: a small expression tree, compiled to a Spark column that is never null.

Since every leaf is wrapped so that it is true or false, And, Or and Not are
two-valued. For a WHERE clause, `where` leaves the wrapping out wherever null and
false come to the same, which lets Parquet see the predicates. Fields resolve to typed columns or, for metadata without a schema, to
paths of a VARIANT column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, LongType, NumericType, StringType, StructType, TimestampType

from ..functions.metrics import haversine_km
from ..functions.text import ascii_lower



def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _between(x: Column, low: float | None, high: float | None) -> Column:
    out = x.isNotNull() & ~F.isnan(x)
    if low is not None:
        out &= x >= F.lit(float(low))
    if high is not None:
        out &= x <= F.lit(float(high))
    return out


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "nested"


class Typed:
    """Fields are the columns of a DataFrame, or of a struct column of it.

    Dates and timestamps equal strings that mean them, and ranges of them are in seconds
    since 1970; binary columns equal nothing.
    """

    def __init__(self, df: DataFrame, struct: str | None = None):
        schema = df.schema
        if struct is not None:
            inner = schema[struct].dataType
            assert isinstance(inner, StructType)
            schema = inner
        self.types: dict[str, DataType] = {f.name: f.dataType for f in schema.fields}
        self.at = {name: df[struct][name] if struct else df[name] for name in self.types}

    def equals(self, field: str, value: Any) -> Column:
        kind = self.types.get(field)
        if kind is None or value is None or (isinstance(value, float) and math.isnan(value)):
            return F.lit(False)
        if isinstance(kind, (DateType, TimestampType)):
            return self.at[field] == F.lit(value).try_cast(kind) if isinstance(value, str) else F.lit(False)
        fits = {"bool": BooleanType, "number": NumericType, "string": StringType}.get(_kind(value))
        if fits is None:
            return F.to_json(self.at[field]) == json.dumps(value, separators=(",", ":")) if not isinstance(kind, (BooleanType, NumericType, StringType)) else F.lit(False)
        if isinstance(kind, IntegralType) and isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
            value = int(value)
        return self.at[field] == F.lit(value) if isinstance(kind, fits) else F.lit(False)

    def among(self, field: str, values: Sequence[Any]) -> Column:
        """Equal to one of the values, as one set where the type allows it."""
        kind = self.types.get(field)
        if isinstance(kind, StringType):
            return self.at[field].isin([v for v in values if isinstance(v, str)])
        numbers = [v for v in values if _kind(v) == "number" and abs(v) < 2**53]
        if isinstance(kind, LongType) and len(numbers) == len(values):
            return self.at[field].isin([int(v) for v in numbers if v == int(v)])
        return reduce(lambda a, b: a | b, [self.equals(field, v) for v in values]) if values else F.lit(False)

    def exists(self, field: str) -> Column:
        return self.at[field].isNotNull() if field in self.types else F.lit(False)

    def within(self, field: str, low: float | None, high: float | None) -> Column:
        kind = self.types.get(field)
        if isinstance(kind, DateType):
            return _between(F.unix_date(self.at[field]).cast("double") * 86_400, low, high)
        if isinstance(kind, TimestampType):
            return _between(self.at[field].cast("double"), low, high)
        if not isinstance(kind, NumericType):
            return F.lit(False)
        x = self.at[field]
        if not isinstance(kind, IntegralType) or any(b is not None and not abs(b) < 2**62 for b in (low, high)):
            return _between(x.cast("double"), low, high)
        out = x.isNotNull()
        if low is not None:
            out &= x >= F.lit(math.ceil(low))
        if high is not None:
            out &= x <= F.lit(math.floor(high))
        return out

    def text(self, field: str) -> Column:
        return self.at[field] if isinstance(self.types.get(field), StringType) else F.lit(None).cast("string")

    def point(self, field: str) -> tuple[Column, Column]:
        kind = self.types.get(field)
        if isinstance(kind, StructType) and {"lat", "lng"} <= set(kind.names):
            return self.at[field]["lat"].cast("double"), self.at[field]["lng"].cast("double")
        return F.lit(None).cast("double"), F.lit(None).cast("double")


class Dynamic:
    """Fields are members of a VARIANT column that holds an object."""

    def __init__(self, variant: Column):
        self.variant = variant

    @staticmethod
    def path(*fields: str) -> str:
        return "$" + "".join("['" + f.replace("'", "\\'") + "']" for f in fields)

    def get(self, *fields: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.variant, self.path(*fields), kind)

    def kind(self, *fields: str) -> Column:
        """number, string, bool, null, nested, or SQL null for a missing field."""
        s = F.schema_of_variant(self.get(*fields))
        return F.when(s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.isNotNull(), "nested")

    def equals(self, field: str, value: Any) -> Column:
        kind = _kind(value)
        same = self.kind(field) == kind
        match kind:
            case "null":
                return same
            case "nested":
                return same & (F.to_json(self.get(field)) == json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False))
            case _:
                typed = {"bool": "boolean", "number": "double", "string": "string"}[kind]
                return same & (self.get(field, kind=typed) == F.lit(float(value) if kind == "number" else value))

    def among(self, field: str, values: Sequence[Any]) -> Column:
        return reduce(lambda a, b: a | b, [self.equals(field, v) for v in values]) if values else F.lit(False)

    def exists(self, field: str) -> Column:
        return self.get(field).isNotNull()

    def number(self, *fields: str) -> Column:
        return F.when(self.kind(*fields) == "number", self.get(*fields, kind="double"))

    def within(self, field: str, low: float | None, high: float | None) -> Column:
        return _between(self.number(field), low, high)

    def text(self, field: str) -> Column:
        return F.when(self.kind(field) == "string", self.get(field, kind="string"))

    def point(self, field: str) -> tuple[Column, Column]:
        return self.number(field, "lat"), self.number(field, "lng")


Fields = Typed | Dynamic


@dataclass(frozen=True)
class Filter:
    def raw(self, fields: Fields) -> Column:
        """True, or false or null."""
        raise NotImplementedError

    def column(self, fields: Fields) -> Column:
        """True or false, never null."""
        return _sure(self.raw(fields))

    def where(self, fields: Fields) -> Column:
        """The same for a WHERE clause, which drops rows of null."""
        return self.raw(fields)

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Eq(Filter):
    """Same type and value; whole and fractional numbers compare as doubles."""

    field: str
    value: Any

    def raw(self, fields: Fields) -> Column:
        return fields.equals(self.field, self.value)


@dataclass(frozen=True)
class Ne(Filter):
    """The negation of Eq: true where the field is missing."""

    field: str
    value: Any

    def raw(self, fields: Fields) -> Column:
        return ~_sure(fields.equals(self.field, self.value))

    def where(self, fields: Fields) -> Column:
        same = fields.equals(self.field, self.value)
        return ~same | same.isNull() if isinstance(fields, Dynamic) or self.field not in fields.types else ~same | fields.at[self.field].isNull()


@dataclass(frozen=True)
class Range(Filter):
    """A number within both bounds, which are included; None is unbounded."""

    field: str
    low: float | None = None
    high: float | None = None

    def raw(self, fields: Fields) -> Column:
        return fields.within(self.field, self.low, self.high)


@dataclass(frozen=True)
class In(Filter):
    """Equal to one of the values; false for none."""

    field: str
    values: tuple

    def raw(self, fields: Fields) -> Column:
        return fields.among(self.field, self.values)


@dataclass(frozen=True)
class Exists(Filter):
    """The field is there; in metadata without a schema, even if it is an explicit null."""

    field: str

    def raw(self, fields: Fields) -> Column:
        return fields.exists(self.field)


@dataclass(frozen=True)
class Text(Filter):
    """A string that holds the pattern, whatever the case of ASCII letters; an empty string holds none."""

    field: str
    pattern: str

    def raw(self, fields: Fields) -> Column:
        x = fields.text(self.field)
        return ascii_lower(x).contains(ascii_lower(F.lit(self.pattern))) & (F.length(x) > 0)


@dataclass(frozen=True)
class Geo(Filter):
    """A point within so many metres."""

    field: str
    lat: float
    lng: float
    metres: float

    def raw(self, fields: Fields) -> Column:
        lat, lng = fields.point(self.field)
        km = haversine_km(lat, lng, F.lit(float(self.lat)), F.lit(float(self.lng)))
        return ~F.isnan(km) & (km <= F.lit(self.metres / 1000.0))


@dataclass(frozen=True)
class And(Filter):
    """All; true for none."""

    parts: tuple[Filter, ...]

    def column(self, fields: Fields) -> Column:
        return reduce(lambda a, b: a & b, [p.column(fields) for p in self.parts]) if self.parts else F.lit(True)

    def where(self, fields: Fields) -> Column:
        return reduce(lambda a, b: a & b, [p.where(fields) for p in self.parts]) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Or(Filter):
    """Any; false for none."""

    parts: tuple[Filter, ...]

    def column(self, fields: Fields) -> Column:
        return reduce(lambda a, b: a | b, [p.column(fields) for p in self.parts]) if self.parts else F.lit(False)

    def where(self, fields: Fields) -> Column:
        return reduce(lambda a, b: a | b, [p.where(fields) for p in self.parts]) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, fields: Fields) -> Column:
        return ~self.part.column(fields)

    def where(self, fields: Fields) -> Column:
        return self.column(fields)


def _number(field: str, op: str, value: Any) -> float:
    if _kind(value) != "number":
        raise ValueError(f"{op} on {field!r} needs a number, not {value!r}")
    return float(value)


def parse_filter(raw: Any, strict: bool = True) -> Filter | None:
    """The filter that a JSON filter means, or None for no filter.

    A plain value is equality; {"$eq"}, {"$ne"}, {"$gt"}, {"$lt"} (both include
    their bound), {"$in"}, {"$text"} and {"$geo": {lat, lng, radius in metres}}
    combine by And. What is unknown or malformed raises; with strict=False it
    is ignored.
    """
    if isinstance(raw, str):
        raw = json.loads(raw)
    if not isinstance(raw, Mapping):
        return None
    parts: list[Filter] = []
    for field, wanted in raw.items():
        if not isinstance(wanted, Mapping):
            parts.append(Eq(field, wanted))
            continue
        low = high = None
        for op, value in wanted.items():
            if op == "$eq":
                parts.append(Eq(field, value))
            elif op == "$ne":
                parts.append(Ne(field, value))
            elif op == "$gt" and (strict or _kind(value) == "number"):
                low = _number(field, op, value)
            elif op == "$lt" and (strict or _kind(value) == "number"):
                high = _number(field, op, value)
            elif op == "$in" and isinstance(value, Sequence) and not isinstance(value, str):
                parts.append(In(field, tuple(value)))
            elif op == "$text" and isinstance(value, str):
                parts.append(Text(field, value))
            elif op == "$geo" and isinstance(value, Mapping):
                parts.append(Geo(field, *(_number(field, op, value.get(k, 0)) for k in ("lat", "lng", "radius"))))
            elif strict:
                raise ValueError(f"bad operator {op!r} on {field!r}: {value!r}")
        if low is not None or high is not None:
            parts.append(Range(field, low, high))
        if strict and not wanted:
            raise ValueError(f"no operator on {field!r}")
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else And(tuple(parts))
