"""Survey data derived from the driver's tables, alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import with_matrices
from ..functions.linalg import num
from ..operators.raster import explode_tile

FOCAL, ROWS, COLS = 1000.0, 480, 640
SIDE = 8  # an embedding's 64 numbers are one 8 x 8 tile

#: Cameras: a grid of suppliers. The same derivation as :func:`cameras`.
CAMERA_SQL = f"""cam AS (
  SELECT s_suppkey::INT AS img_id, 'img' || s_suppkey || '.jpg' AS img_name,
    ((s_suppkey % 10) * 40)::DOUBLE AS x, (s_suppkey // 10 * 60)::DOUBLE AS y, (120 + s_suppkey % 5)::DOUBLE AS z,
    radians((s_nationkey - 12) * 0.1::DOUBLE) AS o, radians((s_suppkey % 7 - 3) * 0.2::DOUBLE) AS p, radians((s_suppkey % 5 - 2)::DOUBLE) AS k,
    {FOCAL}::DOUBLE AS c, {COLS / 2}::DOUBLE AS cx, {ROWS / 2}::DOUBLE AS cy, {ROWS} AS nrows, {COLS} AS ncols
  FROM supplier)"""

#: Entries of the rotation matrix over the angles o, p, k of ``cam``.
ROTATION_SQL = {
    "r00": "cos(p) * cos(k)",
    "r01": "cos(o) * sin(k) + sin(o) * sin(p) * cos(k)",
    "r02": "sin(o) * sin(k) - cos(o) * sin(p) * cos(k)",
    "r10": "cos(p) * sin(k)",
    "r11": "-(cos(o) * cos(k) - sin(o) * sin(p) * sin(k))",
    "r12": "-(sin(o) * cos(k) + cos(o) * sin(p) * sin(k))",
    "r20": "-sin(p)",
    "r21": "sin(o) * cos(p)",
    "r22": "-(cos(o) * cos(p))",
}
ROT_SQL = CAMERA_SQL + ", rot AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in ROTATION_SQL.items()) + " FROM cam)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        key.cast("int").alias("img_id"),
        F.concat(F.lit("img"), key, F.lit(".jpg")).alias("img_name"),
        ((key % 10) * 40).cast("double").alias("x"),
        (F.floor(key / 10) * 60).cast("double").alias("y"),
        (key % 5 + 120).cast("double").alias("z"),
        ((F.col("s_nationkey") - 12) * num(0.1)).alias("omega"),
        ((key % 7 - 3) * num(0.2)).alias("phi"),
        (key % 5 - 2).cast("double").alias("kappa"),
        num(FOCAL).alias("c"),
        num(COLS / 2).alias("x0"),
        num(-ROWS / 2).alias("y0"),
        F.lit(ROWS).alias("nrows"),
        F.lit(COLS).alias("ncols"),
    )
    return with_matrices(rows)


def pairs(cams: DataFrame) -> DataFrame:
    """Neighbours (i, i + 1) in a row of the grid, with all columns of both as left_ and right_."""
    left = cams.select(*[F.col(c).alias(f"left_{c}") for c in cams.columns])
    right = cams.select(*[F.col(c).alias(f"right_{c}") for c in cams.columns])
    near = left.withColumn("next", F.col("left_img_id") + 1).filter(F.col("left_img_id") % 10 != 9)
    return near.join(right, F.col("next") == F.col("right_img_id")).drop("next")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return cameras(spark, sf).select("img_id", "img_name", F.col("img_id").alias("img_param_id"))


def stereo(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-stereo rows of even images; every third of them has a cloud."""
    i = F.col("img_id")
    rows = images(spark, sf).filter(i % 2 == 0)
    ready = i % 3 == 0
    return rows.select((i + 1000).alias("ms_id"), i.alias("base_img_id"), ready.alias("pc_ready"), F.when(ready, i + 5000).alias("pc_id"))


def clouds(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("img_id")
    return images(spark, sf).filter(i % 3 == 0).select((i + 5000).alias("pc_id"), F.concat(F.lit("img"), i).alias("pc_name"))


IMAGE_SQL = CAMERA_SQL + ", image AS (SELECT img_id, img_name, img_id AS img_param_id FROM cam)"
STEREO_SQL = """ms AS (SELECT img_id + 1000 AS ms_id, img_id AS base_img_id, img_id % 3 = 0 AS pc_ready, CASE WHEN img_id % 3 = 0 THEN img_id + 5000 END AS pc_id FROM image WHERE img_id % 2 = 0),
pc AS (SELECT img_id + 5000 AS pc_id, 'img' || img_id AS pc_name FROM image WHERE img_id % 3 = 0)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, y, x, d): pixels of the 8 x 8 tiles."""
    return explode_tile(whole_tiles(spark, sf), "e", SIDE, ["vec_id", "label"])


def whole_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with their numbers as ``e``; one that is no 8 x 8 tile is an error."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    wrong = F.raise_error(F.concat(F.lit("an embedding of a length other than 64: "), size.cast("string")))
    return table(spark, sf, "embeddings").withColumn("e", F.when(size == SIDE * SIDE, F.col("embedding")).otherwise(wrong.cast("array<float>")))


TILE_SQL = f"""px AS (
  SELECT vec_id, label, (p // {SIDE})::INT AS y, (p % {SIDE})::INT AS x, embedding[p + 1]::DOUBLE AS d
  FROM (SELECT *, unnest(range(0, len(embedding))) AS p FROM embeddings))"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Cloud points of lineitem: base, X, Y, Z, r, g, b with the row's own keys."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("base"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("X"), F.col("l_quantity").alias("Y"), F.col("l_discount").alias("Z"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("g"), (F.col("l_suppkey") % 256).cast("int").alias("b"),
    )
