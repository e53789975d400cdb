"""Vector arithmetic in doubles over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length one; null, empty and zero vectors stay null."""
    # The length is an element of an array, as inside the inner function it would be taken anew for each component.
    of = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))
    return F.element_at(F.transform(F.array(norm(a)), of), 1)


def cosine(a: Column, b: Column, undefined: float | None = None) -> Column:
    """Cosine; ``undefined`` where a vector is null, empty or zero, or lengths differ."""
    size = norm(a) * norm(b)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(undefined))


def cut_cosine(a: Column, b: Column) -> Column:
    """Cosine for cut points: where it is undefined there is no cut (1.0)."""
    return F.coalesce(cosine(a, b), F.lit(1.0))
