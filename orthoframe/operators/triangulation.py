"""N-view triangulation of pixels as column arithmetic, and what becomes of the points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import centre, ray, transfer
from ..functions.linalg import Mat, midpoint, num


#: World places; X and Y would clash with the pixel's x and y, as names are alike in both cases.
WORLD = ("east", "north", "height")


def triangulate(rows: DataFrame, by: Sequence[str] = ("base", "y", "x")) -> DataFrame:
    """(by..., east, north, height, views): mean over sides of the midpoint between the two rays of a pixel.

    Needs x, y, d, k (camera matrix), left_map, right_map, left_rotation_matrix,
    right_rotation_matrix and centres left_x.. and right_x... Parallel rays give null points.
    """
    k = Mat.of("k")
    moved = transfer(F.col("x").cast("double"), F.col("y").cast("double"), F.col("d"), Mat.of("left_map"), Mat.of("right_map"))
    sides = rows.withColumns({"right_px": moved[0], "right_py": moved[1]})
    left = ray(F.col("x").cast("double"), F.col("y").cast("double"), k, Mat.of("left_rotation_matrix"))
    right = ray(F.col("right_px"), F.col("right_py"), k, Mat.of("right_rotation_matrix"))
    rays = sides.withColumns({f"r{i}": c for i, c in enumerate(left)} | {f"s{i}": c for i, c in enumerate(right)})
    point = midpoint(centre("left_"), [F.col(f"r{i}") for i in range(3)], centre("right_"), [F.col(f"s{i}") for i in range(3)])
    each = rays.select(*by, *[c.alias(n) for c, n in zip(point, WORLD, strict=True)])
    return each.groupBy(*by).agg(*[F.avg(n).alias(n) for n in WORLD], F.count(F.lit(1)).alias("views"))


def as_points(points: DataFrame) -> DataFrame:
    """Triangulated and coloured pixels as cloud rows (base, X, Y, Z, r, g, b, views)."""
    return points.select("base", *[F.col(w).alias(n) for w, n in zip(WORLD, "XYZ", strict=True)], "r", "g", "b", "views")


def colour(points: DataFrame, pixels: DataFrame, by: Sequence[str] = ("base", "y", "x")) -> DataFrame:
    """Points with r, g, b of their base pixel."""
    return points.join(pixels.select(*by, "r", "g", "b"), list(by))


def extent(points: DataFrame, base: str = "base", x: str = "X", y: str = "Y") -> DataFrame:
    """(base, footprint, n_points): ring (low x, low y), (low, high), (high, high), (high, low)."""
    box = points.groupBy(base).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n_points"))
    ring = F.array(*[F.array(a, b) for a, b in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"))])
    return box.select(base, ring.alias("footprint"), "n_points")


def ply_line(x: Column, y: Column, z: Column, r: Column, g: Column, b: Column, views: Column | None = None) -> Column:
    """One vertex of an ASCII cloud."""
    whole = [r, g, b] + ([] if views is None else [views])
    return F.format_string(" ".join(["%f"] * 3 + ["%d"] * len(whole)), x, y, z, *whole)


def shift_to_origin(points: DataFrame, settings: DataFrame) -> DataFrame:
    """X and Y less the survey's shifts; ``settings`` is its single row."""
    one = settings.select("x_shift", "y_shift").limit(1)
    moved = points.join(F.broadcast(one))
    return moved.withColumns({"X": F.col("X") - F.col("x_shift"), "Y": F.col("Y") - F.col("y_shift")}).drop("x_shift", "y_shift")


def mean_height(images: DataFrame, las: DataFrame) -> DataFrame:
    """One row: mean camera height less mean ground height."""
    ground = las.agg(F.avg("z").alias("ground"))
    return images.agg(F.avg("z").alias("cameras")).join(F.broadcast(ground)).select((F.col("cameras") - F.col("ground")).alias("mean_flying_height"), num(0).alias("zero")).drop("zero")
