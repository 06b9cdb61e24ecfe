"""Points, lines, curves and matrices in arrays, and matrices across rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _a(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def log_base(x, base) -> Column:
    """The logarithm to any base; null where either isn't positive or the base is 1."""
    x, base = (c.cast("double") if isinstance(c, Column) else F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c)) for c in (x, base))
    return F.when((x > 0) & (base > 0) & (base != 1), F.log(x) / F.log(base))


def point_op(a, b, f: Callable[[Column, Column], Column]) -> Column:
    """Element by element; ``b`` may be a number for all elements."""
    a = _a(a)
    return F.transform(a, lambda x: f(x, F.lit(b))) if isinstance(b, (int, float)) else F.zip_with(a, _a(b), f)


def add(a, b) -> Column:
    return point_op(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return point_op(a, b, lambda x, y: x - y)


def multiply(a, b) -> Column:
    return point_op(a, b, lambda x, y: x * y)


def divide(a, b) -> Column:
    return point_op(a, b, lambda x, y: x / y)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_a(a), _a(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def line_at(start, end, t) -> Column:
    t = (F.lit(t) if isinstance(t, (int, float)) else _a(t)).cast("double")
    return F.when(t.between(0, 1), F.zip_with(_a(start), _a(end), lambda a, b: a + (b - a) * t)).when(t.isNotNull(), F.raise_error(F.lit("a place outside 0 to 1")).cast("array<double>"))


def bezier_at(points: list, t) -> Column:
    """A Bezier curve of any degree by Bernstein weights."""
    t, n = (F.lit(t) if isinstance(t, (int, float)) else _a(t)).cast("double"), len(points) - 1
    out = None
    for i, p in enumerate(points):
        weight = F.pow(1 - t, F.lit(n - i)) * F.pow(t, F.lit(i)) * math.comb(n, i)
        part = point_op(p, F.array_repeat(weight, F.size(_a(p))), lambda x, w: x * w)
        out = part if out is None else add(out, part)
    return F.when(t.between(0, 1), out).when(t.isNotNull(), F.raise_error(F.lit("a place outside 0 to 1")).cast("array<double>"))


def points_along(place: Callable[[Column], Column], n: int) -> Column:
    """n + 1 equally spaced points of a line or curve."""
    if n < 1:
        raise ValueError("one part at least")
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: place(i / n))


# Small matrices in one row: arrays of arrays.


def transpose(m) -> Column:
    m = _a(m)
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def trace(m) -> Column:
    """The sum of the diagonal; 0 for a matrix that isn't square."""
    m = _a(m)
    total = F.aggregate(F.transform(m, lambda row, i: F.get(row, i)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(m) == F.size(m[0]), total).otherwise(0.0)


def determinant2(m) -> Column:
    m = _a(m)
    return F.when((F.size(m) == 2) & (F.size(m[0]) == 2), m[0][0] * m[1][1] - m[0][1] * m[1][0]).otherwise(0.0)


def determinant3(m) -> Column:
    m = _a(m)

    def minor(i: int, j: int) -> Column:
        return m[1][i] * m[2][j] - m[1][j] * m[2][i]

    return F.when((F.size(m) == 3) & (F.size(m[0]) == 3), m[0][0] * minor(1, 2) - m[0][1] * minor(0, 2) + m[0][2] * minor(0, 1)).otherwise(0.0)


def map_matrix(m, f: Callable[[Column], Column]) -> Column:
    return F.transform(_a(m), lambda row: F.transform(row, f))


def fill(rows: int, columns: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(float(value)), columns), rows)


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (i == j).cast("double")))


def resized(m, rows: int, columns: int) -> Column:
    """Cropped, or filled up with 0."""
    m = _a(m)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.get(F.get(m, i), j), F.lit(0.0))))


def affine(x: float, y: float, rotation: float, scale_x: float, scale_y: float) -> Column:
    """Scale, then rotate, then shift, as a 3 x 3 matrix for column vectors."""
    c, s = math.cos(rotation), math.sin(rotation)
    rows = [[scale_x * c, -scale_y * s, x], [scale_x * s, scale_y * c, y], [0.0, 0.0, 1.0]]
    return F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in rows))


def _kernel(f: Callable[[np.ndarray], object], returns: str) -> Callable:
    @F.pandas_udf(returns)
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda m: None if m is None else f(np.array([list(r) for r in m], float)))

    return run


def _listed(m: np.ndarray) -> list:
    return [list(r) for r in m]


def inverse(m) -> Column:
    """Raises for a singular matrix."""
    return _kernel(lambda x: _listed(np.linalg.inv(x)), "array<array<double>>")(m)


def determinant(m) -> Column:
    return _kernel(lambda x: float(np.linalg.det(x)), "double")(m)


def adjoint(m) -> Column:
    """The transpose of the cofactors; also for singular matrices."""

    def value(x: np.ndarray) -> list:
        n = len(x)
        out = np.ones((1, 1)) if n == 1 else np.array([[(-1) ** (i + j) * np.linalg.det(np.delete(np.delete(x, j, 0), i, 1)) for j in range(n)] for i in range(n)])
        return _listed(out)

    return _kernel(value, "array<array<double>>")(m)


def minor(m, i: int, j: int) -> Column:
    m = _a(m)
    return F.transform(F.filter(m, lambda r, k: k != i), lambda r: F.filter(r, lambda x, k: k != j))


def power(m, n: int) -> Column:
    return _kernel(lambda x: _listed(np.linalg.matrix_power(x, n)), "array<array<double>>")(m)


def matmul(a, b) -> Column:
    """Rows of ``a`` by columns of ``b``; sizes that don't fit raise."""
    a, columns = _a(a), transpose(b)
    product = F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))
    return F.when(F.size(a[0]) == F.size(_a(b)), product).otherwise(F.raise_error(F.lit("sizes don't fit")).cast("array<array<double>>"))


def render(m) -> Column:
    """A matrix as lines of numbers, whole ones without a point."""
    shown = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.array_join(F.transform(_a(m), lambda r: F.array_join(F.transform(r, shown), " ")), "\n")


# Large matrices across rows: (i, j, v), absent entries 0.


def coo_add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    both = a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * sign).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def coo_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: entries meet on the inner index, and sums go before the shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def coo_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def coo_trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))
