"""Vector arithmetic on array columns. Elements are widened to double first and summed from the left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def adjacent(vectors: Column, measure=dot) -> Column:
    """The measure of each vector and the next: one less than there are vectors."""
    n = F.size(vectors)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: measure(F.get(vectors, i - 1), F.get(vectors, i)))).otherwise(F.expr("cast(array() as array<double>)"))


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def kth_smallest(values: Column, k: Column) -> Column:
    """The k-th smallest from 1; k is held within the array."""
    return F.get(F.sort_array(values), F.greatest(F.least(k, F.size(values)), F.lit(1)) - 1)
