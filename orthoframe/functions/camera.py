"""Camera geometry: matrices, footprints, rectification of pairs and disparity shift.

Functions take and return DataFrames; matrices are ``array<array<double>>`` columns, camera
centres the columns ``x, y, z``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linalg import Mat, Vec, add, dehomogenise, num, sub


def camera_matrix(c: Column, x0: Column, y0: Column, downsample: float = 1.0) -> Mat:
    """Focal length and principal point in pixels; the y axis is turned."""
    f, zero = c / num(downsample), num(0)
    return Mat([[f, zero, x0 / num(downsample)], [zero, f, -y0 / num(downsample)], [zero, zero, num(1)]])


def rotation_matrix(omega: Column, phi: Column, kappa: Column) -> Mat:
    """World to camera, from angles in degrees: the transposed rotation with its rows 1 and 2 negated."""
    o, p, k = F.radians(omega), F.radians(phi), F.radians(kappa)
    so, co, sp, cp, sk, ck = F.sin(o), F.cos(o), F.sin(p), F.cos(p), F.sin(k), F.cos(k)
    columns = [
        [cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck],
        [-(cp * sk), co * ck - so * sp * sk, so * ck + co * sp * sk],
        [sp, -(so * cp), co * cp],
    ]
    return Mat([columns[0], [-x for x in columns[1]], [-x for x in columns[2]]])


def with_matrices(cameras: DataFrame, downsample: float = 1.0) -> DataFrame:
    """Adds ``camera_matrix`` and ``rotation_matrix`` from c, x0, y0, omega, phi, kappa."""
    k = camera_matrix(F.col("c"), F.col("x0"), F.col("y0"), downsample)
    r = rotation_matrix(F.col("omega"), F.col("phi"), F.col("kappa"))
    return cameras.withColumns({"camera_matrix": k.column(), "rotation_matrix": r.column()})


def centre(prefix: str = "") -> Vec:
    return [F.col(f"{prefix}{a}") for a in "xyz"]


def footprint(flying_height: Column) -> Column:
    """Ring of four corners (x, y, z) on the ground, clockwise from the top left.

    Needs camera_matrix, rotation_matrix, x, y, z, nrows and ncols. A rotation's inverse is its
    transpose.
    """
    k, back = Mat.of("camera_matrix").rows, Mat.of("rotation_matrix").T
    left, top = -k[0][2], -k[1][2]
    right, bottom = F.col("ncols") - k[0][2], F.col("nrows") - k[1][2]
    corners = []
    for x, y in ((left, top), (right, top), (right, bottom), (left, bottom)):
        ray = [x * flying_height / k[0][0], y * flying_height / k[1][1], flying_height]
        corners.append(F.array(*add(back @ ray, centre())))
    return F.array(*corners)


def ground_sampling(ring: Column, nrows: Column, ncols: Column) -> Column:
    """Mean over the two first sides of a footprint of length per pixel."""

    def length(a: Column, b: Column) -> Column:
        return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))

    return (length(ring[0], ring[1]) / ncols + length(ring[1], ring[2]) / nrows) / num(2)


def project(k: Mat, r: Mat, c: Vec, point: Vec) -> Vec:
    """Pixel of a world point: K R (X - C), dehomogenised."""
    return dehomogenise(k @ (r @ sub(point, c)))


_MATRICES = ("R", "H1", "H2", "I1", "I2", "H_shift")
_BOUNDS = ("x_min", "x_max", "y_min", "y_max")
_NEEDS = tuple(f"{side}_{c}" for side in ("left", "right") for c in ("x", "y", "z", "camera_matrix", "rotation_matrix", "nrows", "ncols"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rectified(p: pd.DataFrame) -> dict[str, np.ndarray]:
    """Rectification of a batch of pairs, as arrays with a row for each."""

    def matrices(name: str) -> np.ndarray:
        return np.array([[list(r) for r in m] for m in p[name]], float).reshape(-1, 3, 3)

    r1, r2, k = (matrices(c) for c in ("left_rotation_matrix", "right_rotation_matrix", "left_camera_matrix"))
    left, right = (p[[f"{s}_{a}" for a in "xyz"]].to_numpy(float) for s in ("left", "right"))
    base = right - left
    # the last row of K R is R's, as K's last row is (0, 0, 1); so it gives the viewing direction
    mean = _unit(_unit(-r1[:, 2]) + _unit(-r2[:, 2]))
    across = np.cross(base, mean)
    out = {"R": np.stack([_unit(base), _unit(across), _unit(np.cross(base, across))], axis=1)}
    undo, back = np.linalg.inv(k), out["R"].transpose(0, 2, 1)
    corners = []
    for i, r, side in ((1, r1, "left"), (2, r2, "right")):
        turned = r @ back  # a rotation, so the homography's inverse needs no general inverse
        out[f"H{i}"], out[f"I{i}"] = k @ turned @ undo, k @ turned.transpose(0, 2, 1) @ undo
        rows, cols = p[f"{side}_nrows"].to_numpy(float), p[f"{side}_ncols"].to_numpy(float)
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            corner = np.einsum("nij,nj->ni", out[f"I{i}"], np.stack([cols * x, rows * y, np.ones(len(p))], axis=1))
            corners.append(corner[:, :2] / corner[:, 2:])
    low, high = np.min(corners, axis=0), np.max(corners, axis=0)
    out |= {"x_min": low[:, 0], "x_max": high[:, 0], "y_min": low[:, 1], "y_max": high[:, 1]}
    out["H_shift"] = np.tile(np.eye(3), (len(p), 1, 1))
    out["H_shift"][:, :2, 2] = np.ceil(low)
    return out


def rectify_pairs(pairs: DataFrame) -> DataFrame:
    """Adds R, H1, H2, their inverses I1 and I2, bounds, H_shift, out_rows and out_cols to pairs of
    cameras with different centres.

    Needs left_/right_ columns x, y, z, camera_matrix, rotation_matrix, nrows, ncols. The left
    camera matrix serves both, as in one survey. R's rows are the base direction, its cross with the
    mean viewing direction, and the cross of the base with that. A chain of products would make
    column expressions that grow with every step (and again wherever a filter on the result is
    pushed through them), so batches of pairs go through NumPy over Arrow.
    """
    matrix, double = T.ArrayType(T.ArrayType(T.DoubleType())), T.DoubleType()
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(m, matrix) for m in _MATRICES], *[T.StructField(c, double) for c in _BOUNDS], T.StructField("out_rows", T.IntegerType()), T.StructField("out_cols", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = _rectified(batch.select(_NEEDS).to_pandas())
            size = [pa.array(np.ceil(out[f"{a}_max"] - out[f"{a}_min"]).astype(np.int32)) for a in "yx"]
            matrices = [pa.array(out[m].tolist(), pa.list_(pa.list_(pa.float64()))) for m in _MATRICES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *matrices, *[pa.array(out[c]) for c in _BOUNDS], *size], schema.names)

    return pairs.mapInArrow(run, schema)


def disparity_shift(flying_height: Column, ratio: float = 0.9) -> Column:
    """Whole pixels (cut towards zero) that the right image moves before matching.

    The left principal point goes straight down by the flying height, into the right image, and
    both go to rectified space; the shift is their distance in x times ``ratio``.
    """
    k = Mat.of("left_camera_matrix")
    left = [k.rows[0][2], k.rows[1][2], num(1)]
    # both lie in the same shifted space, so the shift itself cancels out
    x_left = dehomogenise(Mat.of("I1") @ left)[0]
    ground = add(Mat.of("left_rotation_matrix").T @ [num(0), num(0), flying_height], centre("left_"))
    right = project(Mat.of("right_camera_matrix"), Mat.of("right_rotation_matrix"), centre("right_"), ground)
    x_right = dehomogenise(Mat.of("I2") @ [*right, num(1)])[0]
    return ((x_left - x_right) * num(ratio)).cast("int")


def transfer(x: Column, y: Column, disparity: Column, left_map: Mat, right_map: Mat) -> Vec:
    """A left pixel through rectified space, less its disparity, into the right image."""
    rx, ry = dehomogenise(left_map.inverse() @ [x, y, num(1)])
    return dehomogenise(right_map @ [rx - disparity, ry, num(1)])


def ray(x: Column, y: Column, k: Mat, r: Mat) -> Vec:
    """Direction of a pixel in world space, of unnormalised length."""
    return r.T @ [x - k.rows[0][2], y - k.rows[1][2], k.rows[0][0]]
