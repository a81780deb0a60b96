"""3-vectors and 3x3 matrices as Spark columns.

A :class:`Mat` or a vector is a Python list of scalar expressions, unrolled so that whole-stage
codegen compiles them to plain arithmetic; ``column()`` packs a matrix as ``array<array<double>>``.
Products of many matrices should pass through a column in between, as expressions grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]


def num(x: float) -> Column:
    """A double literal (a bare ``1.0`` in SQL text would be a decimal)."""
    return F.lit(float(x))


def rounded(c: Column) -> Column:
    """Six decimals, rounded alike in every engine."""
    return F.floor(c * num(1e6) + num(0.5)) / num(1e6)


def held(array: Column) -> Column:
    """An array that the optimizer takes as a whole.

    It would replace an entry of an array by the entry's expression; with many entries used many
    times, expressions built in steps would grow by a factor for each step.
    """
    return F.transform(array, lambda x: x)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, k: Column) -> Vec:
    return [x * k for x in a]


def unit(a: Vec) -> Vec:
    """Length one; null for the zero vector."""
    return [F.try_divide(x, norm(a)) for x in a]


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def dehomogenise(a: Vec) -> Vec:
    """First two over the third; null where that is zero."""
    return [F.try_divide(a[0], a[2]), F.try_divide(a[1], a[2])]


class Mat:
    """A 3x3 matrix of expressions, row by row."""

    def __init__(self, rows: Sequence[Sequence[Column]]) -> None:
        self.rows = [list(r) for r in rows]

    @classmethod
    def of(cls, c: Column | str) -> Mat:
        """From a column of type ``array<array<double>>``."""
        c = F.col(c) if isinstance(c, str) else c
        return cls([[c[i][j] for j in range(3)] for i in range(3)])

    def column(self) -> Column:
        return F.array(*[F.array(*r) for r in self.rows])

    def held(self) -> Column:
        """As :meth:`column`, but kept from being merged into what is built on it."""
        return held(self.column())

    @property
    def T(self) -> Mat:
        return Mat(list(zip(*self.rows, strict=True)))

    def __matmul__(self, other: Mat | Vec) -> Mat | Vec:
        if isinstance(other, Mat):
            columns = other.T.rows
            return Mat([[dot(r, c) for c in columns] for r in self.rows])
        return [dot(r, other) for r in self.rows]

    def inverse(self) -> Mat:
        """Adjugate over determinant; null entries for a singular matrix."""
        a, b, c = self.rows
        cofactors = [cross(b, c), cross(c, a), cross(a, b)]
        det = dot(a, cofactors[0])
        return Mat([[F.try_divide(x, det) for x in row] for row in cofactors]).T


def midpoint(z1: Vec, r: Vec, z2: Vec, s: Vec) -> Vec:
    """The point midway between the nearest points of two rays; null for parallel rays."""
    b = sub(z2, z1)
    rr, ss, rs, br, bs = dot(r, r), dot(s, s), dot(r, s), dot(b, r), dot(b, s)
    det = rs * rs - rr * ss
    along_r, along_s = F.try_divide(rs * bs - ss * br, det), F.try_divide(rr * bs - rs * br, det)
    return scale(add(add(z1, scale(r, along_r)), add(z2, scale(s, along_s))), num(0.5))
