"""Row-wise pretreatments of array columns, as expressions (no Python on executors)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def mean(c: Column) -> Column:
    return total(c) / F.size(c)


def sd_pop(c: Column) -> Column:
    m = mean(c)
    return F.sqrt(F.aggregate(c, F.struct(F.lit(0.0).alias("s"), m.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"]) / F.size(c))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row: inside a lambda over an array it would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def area(c: Column) -> Column:
    """x / sum |x|; a zero sum counts as 1."""
    n = _nonzero(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x)))
    return bound(n, lambda n: F.transform(c, lambda x: x / n))


def unit(c: Column) -> Column:
    """x / Euclidean norm; a zero norm counts as 1."""
    n = _nonzero(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)))
    return bound(n, lambda n: F.transform(c, lambda x: x / n))


def minmax(c: Column) -> Column:
    """(x - min) / (max - min); a zero range counts as 1."""
    low, high = F.array_min(c), F.array_max(c)
    return bound(F.struct(low.alias("low"), _nonzero(high - low).alias("range")), lambda b: F.transform(c, lambda x: (x - b["low"]) / b["range"]))


def snv(c: Column) -> Column:
    """Standard normal variate (Barnes, 1989): row mean 0 and population deviation 1; a zero deviation counts as 1."""
    m, s = mean(c), _nonzero(sd_pop(c))
    return bound(F.struct(m.alias("m"), s.alias("s")), lambda b: F.transform(c, lambda x: (x - b["m"]) / b["s"]))


def softmax(c: Column) -> Column:
    powers = bound(F.array_max(c), lambda top: F.transform(c, lambda x: F.exp(x - top)))
    return bound(powers, lambda e: bound(total(e), lambda n: F.transform(e, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def pick(c: Column, indices: list[int]) -> Column:
    """Projection on 0-based positions, in their order."""
    return F.array(*[F.element_at(c, i + 1) for i in indices])


def occluded(c: Column, low: int, high: int, by: Column) -> Column:
    """c with positions low <= i < high taken from `by`."""
    return F.zip_with(F.zip_with(c, by, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.sequence(F.lit(0), F.size(c) - 1), lambda p, i: F.when((i >= low) & (i < high), p["y"]).otherwise(p["x"]))
