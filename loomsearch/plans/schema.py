"""Typed schemas of metadata: declaration, JSON form, and validation as column checks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import Dynamic

KINDS = ("string", "float", "int", "bool", "text", "geo")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    indexable: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("a field needs a name")
        if self.kind not in KINDS:
            raise ValueError(f"unknown field type {self.kind!r}")


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = ()

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError("field names must be unique")

    @classmethod
    def parse(cls, raw: str | Mapping | Sequence) -> Schema:
        """From {"fields": [{"name", "type", "indexable"}]}."""
        if isinstance(raw, str):
            raw = json.loads(raw)
        items = raw.get("fields") if isinstance(raw, Mapping) else raw
        if not isinstance(items, Sequence) or isinstance(items, str):
            raise ValueError("a schema needs an array of fields")
        if not all(isinstance(x, Mapping) and isinstance(x.get("name"), str) for x in items):
            raise ValueError("every field needs a name")
        return cls(tuple(Field(x["name"], x.get("type", "string"), bool(x.get("indexable", False))) for x in items))

    def to_json(self) -> str:
        return json.dumps({"fields": [{"name": f.name, "type": f.kind, "indexable": f.indexable} for f in self.fields]})

    @property
    def text_field(self) -> str | None:
        """The first field of type text, which full-text search reads."""
        return next((f.name for f in self.fields if f.kind == "text"), None)

    def violation(self, metadata: Column) -> Column:
        """Of a VARIANT column: the first declared field that is there with a wrong type, or null."""
        at = Dynamic(metadata)
        return F.coalesce(*[F.when(~_fits(at, f), F.lit(f.name)) for f in self.fields], F.lit(None).cast("string"))

    def check(self, metadata: Mapping[str, Any]) -> None:
        """The same for a Python mapping; raises ValueError."""
        for f in self.fields:
            if f.name in metadata and not _fits_value(f.kind, metadata[f.name]):
                raise ValueError(f"field {f.name!r} is no {f.kind}: {metadata[f.name]!r}")


def _fits(at: Dynamic, f: Field) -> Column:
    kind = at.kind(f.name)
    match f.kind:
        case "string" | "text":
            ok = kind == "string"
        case "float":
            ok = kind == "number"
        case "int":
            x = at.get(f.name, kind="double")
            ok = (kind == "number") & (x == F.floor(x))
        case "bool":
            ok = kind == "bool"
        case _:
            ok = at.get(f.name, "lat").isNotNull() & at.get(f.name, "lng").isNotNull()
    return F.when(at.exists(f.name), F.coalesce(ok, F.lit(False))).otherwise(True)


def _fits_value(kind: str, value: Any) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    match kind:
        case "string" | "text":
            return isinstance(value, str)
        case "float":
            return number
        case "int":
            return number and float(value).is_integer()
        case "bool":
            return isinstance(value, bool)
        case _:
            return isinstance(value, Mapping) and "lat" in value and "lng" in value
