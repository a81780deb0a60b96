"""Projective warps of rasters in blocks, driven by output windows.

A raster is rows ``(img, y0, x0, h, w, data)``: blocks at any places, ``data`` little-endian 32-bit
floats row by row (and band by band in a pixel). An output is a set of windows with a matrix. A window
finds the cells of a grid that lie below its corners' inverse image, meets the blocks of these
cells in an equi-join, and is sampled alone; no task holds an image. Windows with their blocks come
sorted, in one stream of Arrow batches for each task, so that there is no cost for a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import warp
from ..functions.linalg import held, num

TILES = "img string, ty int, tx int, h int, w int, data binary"
BLOCK = ("y0", "x0", "h", "w", "data")


def to_tiles(img: str, array: np.ndarray, size: int) -> list[tuple]:
    """Tile rows of one band."""
    out = []
    for ty in range(math.ceil(array.shape[0] / size)):
        for tx in range(math.ceil(array.shape[1] / size)):
            part = np.ascontiguousarray(array[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size], "<f4")
            out.append((img, ty, tx, *part.shape, part.tobytes()))
    return out


def from_tiles(rows: list, size: int) -> np.ndarray:
    """The band that tile rows make up."""
    height = max(r["ty"] * size + r["h"] for r in rows)
    width = max(r["tx"] * size + r["w"] for r in rows)
    out = np.zeros((height, width), np.float32)
    for r in rows:
        out[r["ty"] * size : r["ty"] * size + r["h"], r["tx"] * size : r["tx"] * size + r["w"]] = np.frombuffer(r["data"], "<f4").reshape(r["h"], r["w"])
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """Runs of rows that agree in ``keys``, one run in memory at a time; rows come sorted by these."""
    held_rows: list[dict] = []
    last = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            key = tuple(row[k] for k in keys)
            if held_rows and key != last:
                yield held_rows
                held_rows = []
            last = key
            held_rows.append(row)
    if held_rows:
        yield held_rows


def by_group(rows: DataFrame, keys: Sequence[str], schema: T.StructType | str, solve: Callable[[list[dict]], Iterator[tuple]], batch: int = 64) -> DataFrame:
    """Applies ``solve`` to the rows of each key; it gives rows of ``schema``. One shuffle and one sort."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        for group in grouped(batches, keys):
            for row in solve(group):
                out.append(row)
                if len(out) == batch:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def paste(blocks: Sequence[dict], y0: int, x0: int, h: int, w: int, bands: int = 1) -> np.ndarray:
    """What blocks hold of a window, as (h, w) or (h, w, bands); zero elsewhere."""
    out = np.zeros((h, w, bands), np.float32)
    for b in blocks:
        data = np.frombuffer(b["data"], "<f4").reshape(b["h"], b["w"], bands)
        top, left = max(b["y0"], y0), max(b["x0"], x0)
        bottom, right = min(b["y0"] + b["h"], y0 + h), min(b["x0"] + b["w"], x0 + w)
        if top < bottom and left < right:
            out[top - y0 : bottom - y0, left - x0 : right - x0] = data[top - b["y0"] : bottom - b["y0"], left - b["x0"] : right - b["x0"]]
    return out[..., 0] if bands == 1 else out


def tile_windows(outputs: DataFrame, size: int) -> DataFrame:
    """Outputs (..., rows, cols) cut into windows y0, x0, h, w of a regular grid."""
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(size)))
    grid = outputs.filter("rows > 0 and cols > 0").withColumn("y0", starts("rows")).withColumn("x0", starts("cols"))
    sizes = {"h": F.least(F.lit(size), F.col("rows") - F.col("y0")).cast("int"), "w": F.least(F.lit(size), F.col("cols") - F.col("x0")).cast("int")}
    return grid.withColumns(sizes).drop("rows", "cols")


def warp_windows(blocks: DataFrame, windows: DataFrame, cell: int, bands: int = 1) -> DataFrame:
    """Warped blocks (out, y0, x0, h, w, data).

    ``windows`` has a row for each block of an output: img, out (its name), matrix (output to input
    places, ``array<array<double>>``), y0, x0, h, w. ``cell`` is the side of the grid in which blocks
    and windows meet, best that of the blocks. Places outside the input are zero; windows that no block
    lies below come as zeros too, but for those of an image without any blocks, which don't come.
    """
    m = F.col("matrix")
    xs, ys = [], []
    for cx in (F.col("x0"), F.col("x0") + F.col("w") - 1):
        for cy in (F.col("y0"), F.col("y0") + F.col("h") - 1):
            u, v, w = (m[i][0] * cx + m[i][1] * cy + m[i][2] for i in range(3))
            xs.append(F.try_divide(u, w))
            ys.append(F.try_divide(v, w))
    limits = blocks.groupBy("img").agg(F.max(F.floor((F.col("y0") + F.col("h") - 1) / cell)).alias("last_y"), F.max(F.floor((F.col("x0") + F.col("w") - 1) / cell)).alias("last_x"))

    def cells(places: list[Column], last: str) -> Column:
        # one pixel more on each side, for interpolation; a division by zero (null) needs all
        low, high = F.least(*places), F.greatest(*places)
        odd = sum((p.isNull().cast("int") for p in places), F.lit(0)) > 0
        first = F.greatest(F.when(odd, F.lit(0)).otherwise(F.floor((low - 1) / cell)), F.lit(0)).cast("int")
        final = F.least(F.when(odd, F.col(last)).otherwise(F.floor((high + 1) / cell)), F.col(last)).cast("int")
        return F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))

    need = windows.join(limits, "img").withColumns({"cy": cells(ys, "last_y"), "cx": cells(xs, "last_x")})
    need = need.withColumn("cy", F.explode_outer("cy")).withColumn("cx", F.explode_outer("cx"))
    need = need.select("img", "out", "matrix", *[F.col(c).alias(f"o_{c}") for c in BLOCK[:4]], "cy", "cx")
    spans = [F.sequence(F.floor(F.col(p) / cell).cast("int"), F.floor((F.col(p) + F.col(n) - 1) / cell).cast("int")) for p, n in (("y0", "h"), ("x0", "w"))]
    placed = blocks.select("img", *BLOCK, F.explode(spans[0]).alias("cy"), spans[1].alias("cx")).withColumn("cx", F.explode("cx"))
    met = need.join(placed, ["img", "cy", "cx"], "left").drop("cy", "cx", "img")

    def solve(rows: list[dict]) -> Iterator[tuple]:
        y0, x0, h, w = (rows[0][f"o_{c}"] for c in BLOCK[:4])
        have = [r for r in rows if r["data"] is not None]
        data = np.zeros((h, w) if bands == 1 else (h, w, bands))
        if have:
            top, left = min(r["y0"] for r in have), min(r["x0"] for r in have)
            patch = paste(have, top, left, max(r["y0"] + r["h"] for r in have) - top, max(r["x0"] + r["w"] for r in have) - left, bands)
            move = np.array([[1, 0, -left], [0, 1, -top], [0, 0, 1]], float)
            data = warp(patch, move @ np.array(rows[0]["matrix"], float), h, w, y0, x0)
        yield rows[0]["out"], y0, x0, h, w, np.ascontiguousarray(data, "<f4").tobytes()

    return by_group(met, ["out", "o_y0", "o_x0"], "out string, y0 int, x0 int, h int, w int, data binary", solve)


def warp_tiles(tiles: DataFrame, maps: DataFrame, size: int) -> DataFrame:
    """Warped tiles (out, ty, tx, h, w, data) of rasters in regular tiles (img, ty, tx, h, w, data).

    ``maps`` has a row for each output: img, out, matrix, rows, cols.
    """
    blocks = tiles.select("img", (F.col("ty") * size).alias("y0"), (F.col("tx") * size).alias("x0"), "h", "w", "data")
    out = warp_windows(blocks, tile_windows(maps.select("img", "out", "matrix", "rows", "cols"), size), size)
    return out.select("out", F.floor(F.col("y0") / size).cast("int").alias("ty"), F.floor(F.col("x0") / size).cast("int").alias("tx"), "h", "w", "data")


def identity() -> Column:
    """A matrix that leaves places as they are: with it, windows are put together from blocks."""
    return held(F.array(*[F.array(*[num(i == j) for j in range(3)]) for i in range(3)]))
