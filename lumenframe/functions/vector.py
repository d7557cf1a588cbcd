"""Vector expressions over array<float> columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it (else each element that a lambda looks at evaluates it again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(a: Column) -> Column:
    """Unit vector, scaled by the largest magnitude first; null for zero, empty or non-finite vectors."""

    def unit(scaled: Column) -> Column:
        return _let(norm(scaled), lambda length: F.transform(scaled, lambda x: x / length))

    def scaled(top: Column) -> Column:
        good = (top > 0) & (top < float("inf")) & ~F.isnan(top)
        return F.when(good, _let(F.transform(a, lambda x: x.cast("double") / top), unit))

    return _let(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), scaled)
