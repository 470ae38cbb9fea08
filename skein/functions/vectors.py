"""Vector arithmetic on array columns, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them is zero: similar to nothing, and last in every order."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalized(a: Column) -> Column:
    """Of unit length; a zero vector stays. The norm is taken once, outside the function of each component."""
    scaled = F.transform(F.array(F.struct(double(a).alias("v"), norm(a).alias("n"))), lambda x: F.transform(x["v"], lambda y: y / x["n"]))[0]
    return F.when(norm(a) > 0, scaled).otherwise(double(a))
