"""Spatial joins of footprints: cells of a grid meet first, exact tests follow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import num


def cells(box: Sequence[Column], size: float) -> Column:
    """Cells of a square grid that a box (x0, y0, x1, y1) touches, as an array of (cx, cy)."""
    xs, ys = [F.sequence(F.floor(box[i] / num(size)), F.floor(box[i + 2] / num(size))) for i in (0, 1)]
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def spatial_join(left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str], size: float, test: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """Rows of both sides whose boxes share a cell and that pass ``test``, each pair once.

    The sides meet in an equi-join on cells, so neither is broadcast and no cross join arises. A
    pair that shares several cells is kept in the one that holds the corner of the boxes'
    intersection nearest the origin, so that nothing must be made distinct after.
    """
    a = left.withColumn("cell", F.explode(cells([F.col(c) for c in left_box], size)))
    b = right.withColumn("cell", F.explode(cells([F.col(c) for c in right_box], size)))
    met = a.join(b, "cell")
    corner = [F.floor(F.greatest(left_box[i], right_box[i]) / num(size)) for i in (0, 1)]
    once = (F.col("cell.cx") == corner[0]) & (F.col("cell.cy") == corner[1])
    return met.filter(once & (test(met) if callable(test) else test)).drop("cell")
