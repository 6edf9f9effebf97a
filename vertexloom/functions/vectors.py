"""Expressions on arrays of doubles. What a lambda needs again and again is bound once by let()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def _scaled(x: Column, n: Column) -> Column:
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def centred(x: Column) -> Column:
    """x less its mean."""
    return let(x, lambda a: let(total(a) / F.size(a), lambda m: F.transform(a, lambda v: v - m)))


def unit(x: Column) -> Column:
    """x over its length; a zero vector stays."""
    return let(x, lambda a: let(norm(a), lambda n: _scaled(a, n)))


def literal_normal(x: Column) -> Column:
    """Centred; scaled to length one only if no centred value is zero."""
    return let(centred(x), lambda c: F.when(F.forall(c, lambda v: v != 0), let(norm(c), lambda n: _scaled(c, n))).otherwise(c))


def standardised(x: Column) -> Column:
    """Centred and of length one; zero if it does not vary or has a value that is not finite."""
    zero = F.transform(x, lambda v: F.lit(0.0))
    return F.when(F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))), unit(centred(x))).otherwise(zero)


def clipped_atanh(r: Column, most: float = 1 - 1e-15) -> Column:
    return F.atanh(F.greatest(F.lit(-most), F.least(F.lit(most), r)))


def inverse_ratio(r: Column, d: int) -> Column:
    """Concentration whose mean resultant length is about r in d + 1 dimensions: the closed form that the fit uses."""
    return (d - 1) * r / (1 - r * r) + d * r / (d - 1)
