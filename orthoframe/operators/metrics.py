"""Accuracy of disparity estimates by image, over masked pixels; images without any are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import num


def d1(rows: DataFrame, image: str, est: str = "est", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """Share of pixels off by more than 3 and by more than 5 % of the truth."""
    off = F.abs(F.col(gt) - F.col(est))
    bad = (off > num(3)) & (off > num(0.05) * F.abs(F.col(gt)))
    return rows.filter(F.col(mask)).groupBy(image).agg(F.avg(F.when(bad, num(1)).otherwise(num(0))).alias("d1"))


def epe(rows: DataFrame, image: str, est: str = "est", gt: str = "gt", mask: str = "mask") -> DataFrame:
    """Mean distance from the truth."""
    return rows.filter(F.col(mask)).groupBy(image).agg(F.avg(F.abs(F.col(est) - F.col(gt))).alias("epe"))
