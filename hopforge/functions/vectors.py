"""Vector arithmetic on ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence) -> Column:
    """A constant vector or matrix."""
    return F.array(*[literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matvec(matrix: Column, x: Column) -> Column:
    """matrix is an array of rows."""
    return F.transform(matrix, lambda row: dot(row, x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def elu(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(a, lambda x: x - top - total)


def argmax(a: Column) -> Column:
    """The first place of the largest entry, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def sum_of(column: str, width: int) -> Column:
    """Elementwise sum of a vector column over a group."""
    return F.array(*[F.sum(F.col(column)[i]) for i in range(width)])


def mean_of(column: str, width: int) -> Column:
    """Elementwise mean of a vector column over a group."""
    return F.array(*[F.avg(F.col(column)[i]) for i in range(width)])
