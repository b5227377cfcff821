"""Vector arithmetic on array columns, in built-in higher-order functions.

These are the declarative forms: exact, null-safe, fit for checks and small vectors. Volume work
goes through the Arrow kernels of :mod:`kinfold.operators`, which hold the same contracts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def zip_apply(a: Column, b: Column, op) -> Column:
    """Element-wise ``op``; a missing element on either side gives null."""
    return F.zip_with(as_double(a), as_double(b), op)


def subtract(a: Column, b: Column) -> Column:
    return zip_apply(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return zip_apply(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element-wise quotient; a zero divisor gives NaN."""
    return zip_apply(a, b, lambda x, y: F.when(y == 0, F.lit(float("nan"))).otherwise(x / y))


def total(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """``v / |v|``; a zero vector gives null, which callers drop or report."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(F.array(norm), lambda n: F.transform(as_double(v), lambda x: x / n))[0])


def power_normalize(v: Column) -> Column:
    """Signed square root of each element."""
    return F.transform(as_double(v), lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def raise_to(v: Column, exponent: float) -> Column:
    return F.transform(as_double(v), lambda x: F.pow(x, F.lit(exponent)))


def blocks(*matrices: Column) -> Column:
    """Row-major flattening of array-of-array columns, one after the other."""
    return F.concat(*(F.flatten(m) for m in matrices))


def contains_class(matches: Column, label: Column, n: int) -> Column:
    """Whether one of the first ``n`` matches has the class ``label``."""
    return F.exists(F.slice(matches, 1, n), lambda m: m["class"] == label)


def to_bytes(v: Column) -> Column:
    """Values of 0 to 1 as bytes' values: times 255, clipped, then truncated."""
    return F.transform(as_double(v), lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255))))
