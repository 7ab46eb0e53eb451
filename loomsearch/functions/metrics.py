"""Vector metrics and great-circle distance as JVM-side column expressions.

All scores are "higher is better"; the Euclidean score is the negated distance.
Vectors are cast to double first. Results for null vectors are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


class Metric(Enum):
    """How two vectors are compared."""

    COSINE = "cosine"
    L2 = "l2"
    IP = "ip"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        """From any of its accepted names; ValueError for others."""
        if isinstance(name, Metric):
            return name
        found = {"cosine": cls.COSINE, "l2": cls.L2, "euclidean": cls.L2, "ip": cls.IP, "inner_product": cls.IP}.get(name)
        if found is None:
            raise ValueError(f"unknown metric {name!r}")
        return found

    def __str__(self) -> str:
        return self.value


def vector(values: Column | Sequence[float]) -> Column:
    """A column of doubles, or a literal one."""
    if isinstance(values, Column):
        return values.cast("array<double>")
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for empty vectors."""
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; 0 where either vector has no length."""
    lengths = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / lengths)


def score(metric: str | Metric, a: Column, b: Column) -> Column:
    match Metric.parse(metric):
        case Metric.COSINE:
            return cosine(a, b)
        case Metric.L2:
            return -F.sqrt(squared_l2(a, b))
        case _:
            return dot(a, b)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_KM)
