"""Vector arithmetic on ARRAY<FLOAT> columns, in DOUBLE, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def scale(a: Column, by: float | Column) -> Column:
    return F.transform(as_doubles(a), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)


def normalize(a: Column) -> Column:
    """The vector with length 1; a vector without length stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_doubles(a), lambda x: x / n)).otherwise(as_doubles(a))


def array_of(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")
