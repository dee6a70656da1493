"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, floor: float = 1e-12) -> Column:
    """Unit length; a vector shorter than ``floor`` is divided by it."""
    return F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(floor)), F.size(v)).alias("n")), lambda z: z["x"] / z["n"])


def cosine_distance(a: Column, b: Column, floor: float = 1e-12) -> Column:
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def mean(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def variance(v: Column) -> Column:
    """Population variance of an array's elements."""
    m = mean(v)
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)


def argmax(v: Column) -> Column:
    """Index (from 0) of the largest element, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def mean_pairwise_distance(vectors: Column) -> Column:
    """Mean of 1 - dot over pairs i < j of an array of unit vectors."""
    n = F.size(vectors)
    rows = F.transform(vectors, lambda a, i: F.aggregate(F.slice(vectors, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda s, b: s + (1 - dot(a, b))))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x) / (n * (n - 1) / 2)


def odd_one_out(vectors: Column) -> Column:
    """Index of the vector with the largest summed distance to the others, the first of equal ones."""
    sums = F.transform(vectors, lambda a, i: F.aggregate(F.transform(vectors, lambda b, j: F.when(i == j, F.lit(0.0)).otherwise(1 - dot(a, b))), F.lit(0.0), lambda s, x: s + x))
    return argmax(F.transform(sums, lambda x: F.round(x, 9)))
