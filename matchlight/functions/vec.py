"""Vector expressions over array<double> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    """Cell by cell."""
    return F.zip_with(a, b, lambda x, y: x * y)


def shift(x: Column, c: Column) -> Column:
    """A number added to every cell."""
    return F.transform(x, lambda v: v + c)


def scale(x: Column, c: Column) -> Column:
    """Every cell times a number."""
    return F.transform(x, lambda v: v * c)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def matrix(m: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])


def matvec(m: Column, x: Column) -> Column:
    """m x for m as array of rows."""
    return F.transform(m, lambda row: dot(row, x))


def mahalanobis(a: Column, b: Column, m: Column) -> Column:
    """sqrt(max((a-b)' M (a-b), 0))."""
    return F.sqrt(F.greatest(dot(subtract(a, b), matvec(m, subtract(a, b))), F.lit(0.0)))


def l2_normalise(x: Column) -> Column:
    """x / |x|; a zero vector gives NaN, as there is no guard."""
    norm = F.sqrt(dot(x, x))
    return F.transform(x, lambda v: F.when(norm == 0, F.lit(float("nan"))).otherwise(v / norm))


def hellinger(x: Column, whole: bool = False) -> Column:
    """sqrt(x / sum x); unchanged sums of 0 (or, with whole, under 1) give plain square roots."""
    s = total(x)
    guard = F.floor(s) != 0 if whole else s > 0
    return F.transform(x, lambda v: F.sqrt(F.when(guard, v / s).otherwise(v)))


def truncate(x: Column, k: int) -> Column:
    return F.slice(x, 1, k)


def project(x: Column, mean: Column, rows: Column) -> Column:
    """rows (x - mean): projection of the centred vector."""
    return matvec(rows, subtract(x, mean))


def opq(parts: Sequence[Column], rotation: Column, pieces: int = 4) -> list[Column]:
    """Concatenated parts with two zeros behind, rotated, in equal pieces."""
    x = F.concat(*parts, F.array(F.lit(0.0), F.lit(0.0)))
    turned = matvec(rotation, x)
    n = (F.size(x) / pieces).cast("int")
    return [F.slice(turned, n * i + 1, n) for i in range(pieces)]


def soft_weight(distance: Column, sigma: float = 3.0) -> Column:
    return F.exp(-distance / F.lit(sigma * sigma))


def pair_features(a: Column, b: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """|a-b| g and a b g one after the other, with g the normal density at (a+b)/2."""
    g = lambda x, y: F.exp(-((x + y) / 2 - mu) * ((x + y) / 2 - mu) / (2 * sigma * sigma)) / (sigma * (2 * 3.141592653589793) ** 0.5)
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y) * g(x, y)), F.zip_with(a, b, lambda x, y: x * y * g(x, y)))




def select(x: Column, places: Sequence[int]) -> Column:
    """The cells at the given places, in their order."""
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.get(x, i))


def reshape(x: Column, width: int) -> Column:
    """A vector as rows of the given width."""
    n = F.floor(F.size(x) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.slice(x, r * width + 1, width))
