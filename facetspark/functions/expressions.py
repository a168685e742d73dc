"""Scalar expressions: rounding, types, bins, mixed-radix codes, rescaling, geometry and kernels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def square(x: Column) -> Column:
    return x * x


def rounded(x: Column) -> Column:
    """Half away from zero, as a bigint."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint")


def fixed(x: Column, digits: int = 6) -> Column:
    """x on a decimal grid, by the same arithmetic in every engine."""
    return F.floor(x * float(10**digits) + 0.5).cast("double") / float(10**digits)


def curvature_type(gauss: Column, mean: Column) -> Column:
    """2 concave (mean above 0), else 3 saddle (gauss below 0), else 1 convex."""
    return F.when(mean > 0, 2).when(gauss < 0, 3).otherwise(1)


def bin_of(v: Column, thresholds: Sequence[float] | Column) -> Column:
    """How many sorted thresholds are at most v: 0..K. NaN and NULL have no bin."""
    if isinstance(thresholds, Column):
        count = F.size(F.filter(thresholds, lambda t: v >= t))
    else:
        count = reduce(lambda a, t: a + (v >= F.lit(float(t))).cast("int"), thresholds, F.lit(0))
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), count)


def mixed_radix(parts: Sequence[tuple[Column, int | Column]]) -> Column:
    """One code of (order, cardinality) parts, the first being the most significant."""
    return reduce(lambda acc, p: acc * as_column(p[1]) + p[0], parts, F.lit(0).cast("bigint"))


def range_part(v: Column, low: int, high: int, step: int = 1) -> tuple[Column, int]:
    """Order and cardinality of a value of low, low + step ... high."""
    return F.expr("bigint(0)") + F.floor((v - low) / step).cast("bigint"), (high - low) // step + 1


def rescale(v: Column, mean: Column, sigma: Column) -> Column:
    """Clamped to mean +- 3 sigma, then moved and scaled to 0..6; NULL where sigma is 0."""
    return F.try_divide(F.least(F.greatest(v, mean - 3 * sigma), mean + 3 * sigma) - (mean - 3 * sigma), sigma)


def unscale(v: Column, mean: Column, sigma: Column) -> Column:
    return v * sigma + mean - 3 * sigma


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [square(p - q) for p, q in zip(a, b)]))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, summed in order in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: square(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def heron(a: Column, b: Column, c: Column) -> Column:
    """A triangle's area from its sides; 0 where rounding makes the product negative."""
    p = (a + b + c) / 2
    return F.sqrt(F.greatest(p * (p - a) * (p - b) * (p - c), F.lit(0.0)))


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b)])


def tangent_basis(n: Sequence[Column]) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Two unit vectors across a unit normal: the x axis projected (the y axis where the normal is along x), and the cross product."""
    along = F.abs(n[0]) > 1 - 1e-9
    axis = (F.when(along, 0.0).otherwise(1.0), F.when(along, 1.0).otherwise(0.0), F.lit(0.0))
    d = dot(axis, n)
    u = [a - d * c for a, c in zip(axis, n)]
    size = F.sqrt(dot(u, u))
    u = tuple(c / size for c in u)
    return u, cross(n, u)


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of the symmetric matrix ((a, b), (b, c)), the larger first."""
    half, root = (a + c) / 2, F.sqrt(square((a - c) / 2) + b * b)
    return half + root, half - root


def eigen_ratio(a: Column, b: Column, c: Column, gradient: Column, cut: Column | float) -> Column:
    """Ratio of the larger to the smaller eigenvalue by size; 0 below the gradient cut, NULL where singular."""
    big, small = eigen2(a, b, c)
    big, small = F.greatest(F.abs(big), F.abs(small)), F.least(F.abs(big), F.abs(small))
    return F.when(gradient < cut, 0.0).otherwise(F.try_divide(big, small))


def bounded(x: Column, limit: float = 1000.0) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


# Kernels of two numbers.


def gaussian_kernel(x: Column, y: Column, sigma: float) -> Column:
    """0 beyond 4 sigma."""
    d = F.abs(x - y)
    return F.when(d > 4 * sigma, 0.0).otherwise(F.exp(-square(d) / (2 * sigma * sigma)))


def triangle_kernel(x: Column, y: Column, c: float) -> Column:
    return F.greatest(F.lit(0.0), (c - F.abs(x - y)) / c)


def clipped_triangle_kernel(x: Column, y: Column, c: float, limit: float) -> Column:
    """The triangle kernel of values clipped to -limit..limit."""
    return triangle_kernel(bounded(x, limit), bounded(y, limit), c)


def dirac_kernel(x: Column, y: Column) -> Column:
    return (x == y).cast("double")


def constant_kernel(value: float = 1.0) -> Column:
    return F.lit(float(value))


def product_kernel(kernels: Sequence[Column]) -> Column:
    """Product that stops at the first zero."""
    return reduce(lambda rest, k: F.when(k == 0, 0.0).otherwise(k * rest), reversed(list(kernels)), F.lit(1.0))


def either_way(straight: Column, crossed: Column, of_distance: Column) -> Column:
    """A pair's kernel: the better of its two orientations times the distance kernel."""
    return F.greatest(straight, crossed) * of_distance


def f_measure(p: Column, r: Column) -> Column:
    return 2 * r * p / (r + p + 1e-6) + 0.35 * p


def binary_label(y: Column) -> Column:
    """-1 as 0, others as they are."""
    return F.when(y == -1, 0).otherwise(y)


def decode_type(t: Column) -> tuple[Column, Column]:
    """Major and minor part, from 1, of a type code from 1 with three minor parts to a major one."""
    return F.floor((t - 1) / 3).cast("int") + 1, F.pmod(t - 1, F.lit(3)).cast("int") + 1


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a hue in degrees, saturation and value, all of the latter in 0..1."""
    turn = lambda n: F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(turn(n), 4 - turn(n), F.lit(1.0)))
    return part(5), part(3), part(1)


#: Names of curvature types, detectors and channel combinations.
CURVATURE_NAMES = {1: "convex", 2: "concave", 3: "saddle"}
DETECTORS = ("dog", "log", "hess_det")
COMBINATIONS = ("scalar", "manifold_det", "manifold_trace", "pca")


def detector(name: str) -> str:
    """The detector of the name, in any case; unknown names are refused."""
    if name.lower() not in DETECTORS:
        raise ValueError(f"unknown detector {name}")
    return name.lower()


def combination(name: str) -> str:
    if name.lower() not in COMBINATIONS:
        raise ValueError(f"unknown combination {name}")
    return name.lower()


def same_record(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two records agree in all fields; nulls agree with nulls."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out &= x.eqNullSafe(y)
    return out


def same_pair(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Whether two pairs (first, second, distance) are one: the same distance, the same elements in either order."""
    (p, q, d), (r, s, e) = a, b
    straight, turned = same_record((p, q), (r, s)), same_record((p, q), (s, r))
    return d.eqNullSafe(e) & (straight | turned)


def rotation_between(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The 3 x 3 matrix (an array by rows) that turns unit vector a to b about their cross product.

    With v = a x b and c = a . b it is I + [v] + [v][v] / (1 + c); opposite vectors have no axis of their own and are
    turned by half a turn about an axis across a.
    """
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    square = [[sum((cross[i][k] * cross[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    # An axis across a: its cross product with the x axis, or with the y axis where a is close to that one.
    far = F.abs(a[0]) < 0.8
    w = [F.when(far, 0.0).otherwise(-a[2]), F.when(far, a[2]).otherwise(0.0), F.when(far, -a[1]).otherwise(a[0])]
    n = w[0] * w[0] + w[1] * w[1] + w[2] * w[2]
    cells = []
    for i in range(3):
        for j in range(3):
            one = 1.0 if i == j else 0.0
            cells.append(F.when(c > -1 + 1e-12, one + cross[i][j] + square[i][j] / (1 + c)).otherwise(2 * w[i] * w[j] / n - one))
    return F.array(*cells)


def turned(matrix: Column, x: Sequence[Column]) -> list[Column]:
    """matrix (an array by rows) times a vector."""
    return [F.get(matrix, F.lit(3 * i)) * x[0] + F.get(matrix, F.lit(3 * i + 1)) * x[1] + F.get(matrix, F.lit(3 * i + 2)) * x[2] for i in range(3)]


def frame_mean(a: Sequence[Sequence[Column]], b: Sequence[Sequence[Column]], least: float = 1e-5) -> list[list[Column]]:
    """The mean of two frames, given by their axes (two in the tangent plane, then the normal).

    Each axis is the sum of both, scaled to length 1; if the sum of an axis in the plane vanishes, as for frames turned
    against each other, the first frame's two axes change places instead.
    """
    sums = [[(x + y) / 2 for x, y in zip(p, q)] for p, q in zip(a, b)]
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    gone = (length(sums[0]) < least) | (length(sums[1]) < least)
    instead = [a[1], a[0], a[2]]
    return [[F.when(gone, x).otherwise(y / length(v)) for x, y in zip(other, v)] for v, other in zip(sums, instead)]
