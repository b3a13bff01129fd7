"""Vector functions as Column expressions. Vectors are array columns; sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def square(x: Column) -> Column:
    return x * x


def absolute(x: Column) -> Column:
    return F.abs(x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, without the square root."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def residual(v: Column, centroid: Column) -> Column:
    """v - centroid, element by element."""
    return F.zip_with(as_double(v), as_double(centroid), lambda x, y: x - y)


def add_scalar(v: Column, value: Column) -> Column:
    return F.transform(as_double(v), lambda x: x + value)


def subvector(v: Column, group: Column | int, width: int) -> Column:
    """Elements [group * width, (group + 1) * width), group counted from 0."""
    start = F.lit(group) if isinstance(group, int) else group
    return F.slice(v, start * width + 1, width)


def sum_squares(v: Column) -> Column:
    return _sum(F.transform(as_double(v), lambda x: x * x))


def l1_norm(v: Column) -> Column:
    return _sum(F.transform(as_double(v), lambda x: F.abs(x)))


def vec_sum(v: Column) -> Column:
    return _sum(as_double(v))


def l1_diff(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def l1_normalize(v: Column) -> Column:
    norm = l1_norm(v)
    return F.transform(as_double(v), lambda x: x / norm)


def power(base: Column, exponent: Column | float) -> Column:
    return F.pow(base, exponent)


def poly(x: Column, a: float) -> Column:
    """a x^2 + 2 x / a - 3"""
    return F.lit(a) * x * x + F.lit(2.0) * x / F.lit(a) - F.lit(3.0)


def triangle_index(i: Column, j: Column) -> Column:
    """Place of the pair (i, j), i > j, in a strict lower triangle stored row by row."""
    return (i * (i - 1) / 2).cast("long") + j


def orient_pair(i: Column, j: Column) -> tuple[Column, Column]:
    return F.greatest(i, j), F.least(i, j)


def sdc_lookup(triangle: Column, c1: Column, c2: Column) -> Column:
    """Distance of two codes of one group; triangle is that group's array of pair distances."""
    hi, lo = orient_pair(c1, c2)
    return F.when(c1 == c2, F.lit(0.0)).otherwise(F.element_at(triangle, (triangle_index(hi, lo) + 1).cast("int")))


def sdc_distance(triangles: Column, codes1: Column, codes2: Column) -> Column:
    """Sum over the groups of sdc_lookup; triangles is array<array<double>> by group."""
    parts = F.transform(
        F.arrays_zip(triangles.alias("t"), codes1.alias("a"), codes2.alias("b")),
        lambda z: sdc_lookup(z["t"], z["a"], z["b"]),
    )
    return _sum(parts)


def adc_distance(lut: Column, codes: Column) -> Column:
    """Sum over the groups of lut[group][code]; lut is array<array<double>>."""
    return _sum(F.zip_with(lut, codes, lambda row, c: F.element_at(row, c + 1)))


def reconstruct(codebook: Column, codes: Column) -> Column:
    """The sub-centroids that the codes name, one after another; codebook[group][code] is a vector."""
    return F.flatten(F.zip_with(codebook, codes, lambda group, c: F.element_at(group, c + 1)))


def nearest_code(v: Column, centroids: Column) -> Column:
    """Index of the nearest of the centroids (array of vectors); the lowest index wins ties."""
    scored = F.transform(centroids, lambda c, i: F.struct(sq_l2(v, c).alias("d"), i.alias("i")))
    return F.array_min(scored)["i"]


def leibniz_term(n: Column) -> Column:
    """n-th term, from 0, of the series 4 - 4/3 + 4/5 - ..."""
    return F.when(n % 2 == 0, F.lit(4.0)).otherwise(F.lit(-4.0)) / (F.lit(2.0) * n + F.lit(1.0))
