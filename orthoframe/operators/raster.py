"""Raster algebra over pixel rows ``(key..., y, x, d)`` and tile grids.

Pixels are exploded only where a relational operation needs them; every function keeps the key
columns in front, so its shuffles are by key and place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import num


def explode_tile(tiles: DataFrame, data: str, width: int, keep: Sequence[str]) -> DataFrame:
    """(keep..., y, x, d) of row-major tiles, y and x from zero."""
    out = tiles.select(*keep, F.posexplode(data).alias("pos", "d"))
    return out.select(*keep, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), F.col("d").cast("double").alias("d"))


def tile_starts(n: int, tile: int, overlap: int) -> list[int]:
    """Starts along one axis; the last tiles are moved back to end at ``n`` (so one may repeat).

    A tile as long as the axis or longer gives the single start 0.
    """
    if tile >= n:
        return [0]
    if not 0 <= overlap < tile:
        raise ValueError("an overlap shorter than the tile")
    step = tile - overlap
    return [min(s, n - tile) for s in range(0, n, step)]


def kept_range(start: Column, n: int, tile: int, overlap: int) -> tuple[Column, Column]:
    """[low, high) of an axis that a tile owns: half an overlap goes on inner sides."""
    half = overlap // 2
    low = F.when(start == 0, F.lit(0)).otherwise(start + half)
    last = (start >= n - tile) & ((start != 0) | F.lit(tile >= n))
    return low, F.when(last, F.lit(n)).otherwise(start + (tile - half))


def tile_grid(spark: SparkSession, rows: int, cols: int, tile_rows: int, tile_cols: int, overlap_rows: int, overlap_cols: int, distinct: bool = False) -> DataFrame:
    """(tile, ty, tx, y0, x0): the grid row by row; ``distinct`` leaves out repeated places."""
    ys, xs = tile_starts(rows, tile_rows, overlap_rows), tile_starts(cols, tile_cols, overlap_cols)
    if distinct:
        ys, xs = list(dict.fromkeys(ys)), list(dict.fromkeys(xs))
    cells = [(i * len(xs) + j, i, j, y, x) for i, y in enumerate(ys) for j, x in enumerate(xs)]
    return spark.createDataFrame(cells, "tile int, ty int, tx int, y0 int, x0 int")


def _tiles_over(at: Column, places: list[int], tile: int) -> Column:
    """Numbers of the starts (ascending) whose tile covers a place along one axis.

    Starts lie a step apart, but for those moved back to the end; so there are few, and which they are
    follows from the place.
    """
    step = places[1] - places[0] if len(places) > 1 else 1
    moved = sum(1 for p, q in zip(places, places[1:], strict=False) if q - p != step)
    last = len(places) - 1
    low = F.greatest(F.ceil((at - (tile - 1)) / num(max(step, 1))), F.lit(0))
    high = F.least(F.floor(at / num(max(step, 1))) + (moved + 1), F.lit(last))
    covers = lambda i: (F.get(F.array(*map(F.lit, places)), i) <= at) & (at < F.get(F.array(*map(F.lit, places)), i) + tile)
    return F.filter(F.sequence(F.least(low, F.lit(last)).cast("int"), high.cast("int")), covers)


def cut_tiles(pixels: DataFrame, grid: Sequence[tuple[int, int, int, int, int]] | DataFrame, tile_rows: int, tile_cols: int) -> DataFrame:
    """Pixels of every tile of a grid (the result of :func:`tile_grid`), with tile, y0 and x0.

    A pixel's tiles follow from its place, so each pixel becomes as many rows as tiles cover it, and
    no tile is compared with a pixel that it does not cover.
    """
    cells = sorted(tuple(r) for r in grid.collect()) if isinstance(grid, DataFrame) else sorted(grid)  # one image's grid
    ys, xs = [next(c[3] for c in cells if c[1] == i) for i in range(cells[-1][1] + 1)], [next(c[4] for c in cells if c[2] == j) for j in range(max(c[2] for c in cells) + 1)]
    out = pixels.withColumn("ty_", F.explode(_tiles_over(F.col("y"), ys, tile_rows))).withColumn("tx_", F.explode(_tiles_over(F.col("x"), xs, tile_cols)))
    place = lambda places, i: F.get(F.array(*map(F.lit, places)), F.col(i))
    return out.withColumns({"tile": F.col("ty_") * len(xs) + F.col("tx_"), "y0": place(ys, "ty_"), "x0": place(xs, "tx_")}).drop("ty_", "tx_")


def stitch(tiles: DataFrame, keys: Sequence[str], rows: int, cols: int, tile_rows: int, tile_cols: int, overlap_rows: int, overlap_cols: int) -> DataFrame:
    """(keys..., y, x, d) from tile pixels: margins go first, then the last tile owns a pixel."""
    y_low, y_high = kept_range(F.col("y0"), rows, tile_rows, overlap_rows)
    x_low, x_high = kept_range(F.col("x0"), cols, tile_cols, overlap_cols)
    own = tiles.filter((F.col("y") >= y_low) & (F.col("y") < y_high) & (F.col("x") >= x_low) & (F.col("x") < x_high))
    return own.groupBy(*keys, "y", "x").agg(F.max_by("d", "tile").alias("d"))


def block_mean(pixels: DataFrame, keys: Sequence[str], factor: int, rows: int, cols: int) -> DataFrame:
    """Means of factor x factor blocks; a remainder at the right or bottom is left out."""
    whole = pixels.filter((F.col("y") < rows - rows % factor) & (F.col("x") < cols - cols % factor))
    by = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in ("y", "x")]
    return whole.groupBy(*keys, *by).agg(F.avg("d").alias("d"))


def upsample(pixels: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Each pixel repeated factor x factor times, its value times factor (disparities scale)."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1))).alias("k")
    out = pixels.select(*keys, "y", "x", "d", steps)
    y = (F.col("y") * factor + F.floor(F.col("k") / factor)).cast("int").alias("y")
    return out.select(*keys, y, (F.col("x") * factor + F.col("k") % factor).cast("int").alias("x"), (F.col("d") * num(factor)).alias("d"))


def shift_x(pixels: DataFrame, keys: Sequence[str], shift: int, cols: int) -> DataFrame:
    """out(x) = in(x + shift), zero where that lies outside; each pixel moves, none is joined."""
    moved = pixels.withColumn("x", F.col("x") - shift).filter(F.col("x").between(0, cols - 1))
    empty = pixels.filter((F.col("x") + shift < 0) | (F.col("x") + shift >= cols)).withColumn("d", num(0))
    return moved.select(*keys, "y", "x", "d").unionByName(empty.select(*keys, "y", "x", "d"))


def fill_nan(d: Column, value: float = -192.0) -> Column:
    return F.when(F.isnan(d), num(value)).otherwise(d)


def quantise(d: Column) -> Column:
    """Nearest of 256 steps, ties to even, for values in [0, 1]."""
    return F.rint(d * num(255)).cast("int")


def to_uint8(d: Column) -> Column:
    """Times 255, cut towards zero (as the image writer does)."""
    return (d * num(255)).cast("int")


def invert_validity(m: Column) -> Column:
    return F.when(m == 0, 1).otherwise(0)


def clamp(d: Column) -> Column:
    return F.greatest(d, num(0))


def luma(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 luma in 16-bit fixed point: integer in, integer out."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536).cast("int")


def gather(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: int, wrap: bool = False) -> DataFrame:
    """(keys..., y, x, d, other, deviation): a left pixel beside the right one at x - d, cut to whole.

    A place left of the image is null, so its deviation is null and no threshold keeps it; with
    ``wrap`` it is counted from the row's other end instead.
    """
    at = (F.col("x") - F.col("d")).cast("int")
    at = F.pmod(at, F.lit(cols)) if wrap else at
    named = right.select(*keys, "y", F.col("x").alias("at"), F.col("d").alias("other"))
    out = left.withColumn("at", at).join(named, [*keys, "y", "at"], "left")
    return out.select(*keys, "y", "x", "d", "other", (F.col("d") - F.col("other")).alias("deviation"))


def consistent(deviation: Column, threshold: float = 0.75) -> Column:
    """1 where the deviation is below the threshold, else 0 (also for null and NaN)."""
    return F.when(F.abs(deviation) < num(threshold), num(1)).otherwise(num(0))


def common_mask(masks: DataFrame, keys: Sequence[str], n_sides: Column | int) -> DataFrame:
    """Pixels whose mask is 1 on every side of a base: (keys..., y, x)."""
    n = F.lit(n_sides) if isinstance(n_sides, int) else n_sides
    found = masks.groupBy(*keys, "y", "x").agg(F.min("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("mask") == num(1)) & (F.col("n") == n)).drop("mask", "n")


def attention(scores: DataFrame, keys: Sequence[str], column: str, score: str) -> DataFrame:
    """Softmax of the scores of each row (keys), stable by the row's largest: adds ``att``."""
    top = scores.groupBy(*keys).agg(F.max(score).alias("top"))
    raised = scores.join(top, list(keys)).withColumn("e", F.exp(F.col(score) - F.col("top")))
    total = raised.groupBy(*keys).agg(F.sum("e").alias("total"))
    return raised.join(total, list(keys)).select(*keys, column, (F.col("e") / F.col("total")).alias("att"))
