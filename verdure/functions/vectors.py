"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, floor: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / n)


def rescale(v: Column, to: float = 2**0.5) -> Column:
    """To a fixed norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x * F.lit(to) / n)).otherwise(doubles(v))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def zero_if_bad(v: Column, dim: int) -> Column:
    """The whole vector becomes zero if any component isn't finite."""
    return F.when(finite(v), doubles(v)).otherwise(F.array_repeat(F.lit(0.0), dim))


def logit(v: Column, weights: Column, bias: Column) -> Column:
    return dot(v, weights) + bias


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def count_bad(v: Column) -> Column:
    """An aggregate: vectors with a component that isn't finite."""
    return F.count_if(~finite(v))
