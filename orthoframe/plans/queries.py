"""Queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import camera, rings
from ..functions.linalg import Mat, midpoint, num, rounded
from ..operators import catalog, metrics, raster, spatial, triangulation
from ..sources import readers, writers
from ..staging import new_folder
from . import fixtures as fx
from . import rectify_sql

R = "floor(({}) * 1e6 + 0.5) / 1e6"  # as linalg.rounded
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(e: str) -> str:
    return R.format(e)


# --- cameras -------------------------------------------------------------------------------


@query(f"WITH {fx.ROT_SQL} SELECT img_id, x, y, z, c AS fx, cx, cy, " + ", ".join(f"{r(n)} AS {n}" for n in fx.ROTATION_SQL) + " FROM rot")
def q_camera_params(spark: SparkSession, sf: str) -> DataFrame:
    """Camera and rotation matrices."""
    cams = fx.cameras(spark, sf)
    k = F.col("camera_matrix")
    entries = [rounded(F.col("rotation_matrix")[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return cams.select("img_id", "x", "y", "z", k[0][0].alias("fx"), k[0][2].alias("cx"), k[1][2].alias("cy"), *entries)


def _height(spark: SparkSession, sf: str) -> DataFrame:
    las = fx.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("z"))
    return triangulation.mean_height(fx.cameras(spark, sf).select("z"), las)


_HEIGHT_SQL = "h AS (SELECT (SELECT avg(z) FROM cam) - (SELECT avg(l_quantity) FROM lineitem) AS zf)"
_CORNERS = {0: ("-cx", "-cy"), 1: ("ncols - cx", "-cy"), 2: ("ncols - cx", "nrows - cy"), 3: ("-cx", "nrows - cy")}


def _corner_sql(i: int, axis: int) -> str:
    dx, dy = _CORNERS[i]
    return f"r0{axis} * (({dx}) * zf / c) + r1{axis} * (({dy}) * zf / c) + r2{axis} * zf + {'xyz'[axis]}"


_FOOT_SQL = fx.ROT_SQL + ", " + _HEIGHT_SQL + ", foot AS (SELECT *, " + ", ".join(f"{_corner_sql(i, a)} AS {'xyz'[a]}{i}" for i in range(4) for a in range(3)) + " FROM rot, h)"


def _footprints(spark: SparkSession, sf: str) -> DataFrame:
    height = _height(spark, sf)  # one row
    cams = fx.cameras(spark, sf).join(F.broadcast(height))
    return cams.withColumn("geobound", camera.footprint(F.col("mean_flying_height")))


@query(f"WITH {_FOOT_SQL} SELECT img_id, " + ", ".join(f"{r(f'{a}{i}')} AS {a}{i}" for i in range(4) for a in "xyz") + " FROM foot")
def q_footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Image corners on the ground at the mean flying height."""
    g = F.col("geobound")
    return _footprints(spark, sf).select("img_id", *[rounded(g[i][a]).alias(f"{'xyz'[a]}{i}") for i in range(4) for a in range(3)])


@query(
    f"""WITH {_FOOT_SQL}, first AS (SELECT * FROM foot ORDER BY img_id LIMIT 1)
SELECT {r("(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) / ncols + sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / nrows) / 2")} AS estimated_gsd,
  {r("zf")} AS mean_flying_height, 32632 AS epsg, (SELECT min(x) FROM cam) AS x_shift, (SELECT min(y) FROM cam) AS y_shift FROM first"""
)
def q_globals(spark: SparkSession, sf: str) -> DataFrame:
    """The survey's single row of settings."""
    feet = _footprints(spark, sf)
    gsd = camera.ground_sampling(F.col("geobound"), F.col("nrows"), F.col("ncols"))
    return feet.agg(
        rounded(F.min_by(gsd, "img_id")).alias("estimated_gsd"), rounded(F.first("mean_flying_height")).alias("mean_flying_height"),
        F.lit(32632).alias("epsg"), F.min("x").alias("x_shift"), F.min("y").alias("y_shift"),
    )


# --- catalog -------------------------------------------------------------------------------


@query(f"WITH {fx.IMAGE_SQL} SELECT img_name FROM image")
def q_image_list(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all images."""
    return catalog.image_names(fx.images(spark, sf))


@query(f"WITH {fx.IMAGE_SQL} SELECT img_id AS img_param_id, x, y, z, nrows, ncols FROM cam WHERE img_id = (SELECT img_param_id FROM image WHERE img_name = 'img7.jpg')")
def q_image_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of one image by its name."""
    params = fx.cameras(spark, sf).withColumnRenamed("img_id", "img_param_id")
    return catalog.image_params(fx.images(spark, sf), params, "img7.jpg").select("img_param_id", "x", "y", "z", "nrows", "ncols")


@query(f"WITH {fx.CAMERA_SQL}, {_HEIGHT_SQL} SELECT {r('zf')} AS mean_flying_height FROM h LIMIT 1")
def q_global_param(spark: SparkSession, sf: str) -> DataFrame:
    """One setting."""
    return catalog.setting(_height(spark, sf).select(rounded(F.col("mean_flying_height")).alias("mean_flying_height")), "mean_flying_height")


def _pair_table(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.pairs(fx.cameras(spark, sf))
    return p.select((F.col("left_img_id") + 100000).alias("img_pair_id"), F.col("left_img_id").alias("base_img_id"), F.col("right_img_id").alias("side_img_id"), (F.col("left_img_id") + 200000).alias("rect_param_id"))


_PAIR_SQL = fx.IMAGE_SQL + ", pair AS (SELECT a.img_id + 100000 AS img_pair_id, a.img_id AS base_img_id, b.img_id AS side_img_id, a.img_id + 200000 AS rect_param_id FROM image a JOIN image b ON b.img_id = a.img_id + 1 WHERE a.img_id % 10 <> 9)"


@query(f"WITH {_PAIR_SQL} SELECT img_pair_id, a.img_name AS base_name, b.img_name AS side_name FROM pair LEFT JOIN image a ON base_img_id = a.img_id LEFT JOIN image b ON side_img_id = b.img_id WHERE a.img_name IS NOT NULL AND b.img_name IS NOT NULL")
def q_pair_id(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by the names of their images."""
    return catalog.named_pairs(_pair_table(spark, sf), fx.images(spark, sf)).select("img_pair_id", "base_name", "side_name")


@query(f"WITH {fx.ROT_SQL} SELECT img_name, " + ", ".join(f"{r(n)} AS {n}" for n in ("r00", "r11", "r22")) + " FROM rot JOIN (SELECT img_id AS i FROM cam) ON i = img_id")
def q_image_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters joined to images."""
    params = fx.cameras(spark, sf).select(F.col("img_id").alias("img_param_id"), "rotation_matrix")
    m = F.col("rotation_matrix")
    return fx.images(spark, sf).join(params, "img_param_id").select("img_name", *[rounded(m[i][i]).alias(f"r{i}{i}") for i in range(3)])


@query(
    f"""WITH {_PAIR_SQL}, db AS (SELECT * FROM pair WHERE base_img_id % 2 = 0), disk AS (SELECT * FROM pair WHERE base_img_id % 3 = 0)
SELECT coalesce(db.base_img_id, disk.base_img_id) AS base_img_id, coalesce(db.side_img_id, disk.side_img_id) AS side_img_id,
  db.base_img_id IS NOT NULL AS in_db, disk.base_img_id IS NOT NULL AS on_disk,
  CASE WHEN db.base_img_id IS NOT NULL AND disk.base_img_id IS NOT NULL THEN 'load' WHEN db.base_img_id IS NOT NULL THEN 'recompute' ELSE 'register' END AS action
FROM db FULL JOIN disk ON db.base_img_id = disk.base_img_id AND db.side_img_id = disk.side_img_id"""
)
def q_pair_state(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of every pair, in the catalog and on disk."""
    p = _pair_table(spark, sf)
    return catalog.state(p.filter("base_img_id % 2 = 0"), p.filter("base_img_id % 3 = 0"), ["base_img_id", "side_img_id"])


@query(
    f"""WITH {_PAIR_SQL}, s AS (SELECT base_img_id, side_img_id, base_img_id % 2 = 0 AS in_db, base_img_id % 3 = 0 AS on_disk FROM pair)
SELECT *, CASE WHEN in_db AND on_disk THEN 'load' WHEN in_db THEN 'recompute' WHEN on_disk THEN 'register' ELSE 'compute' END AS action FROM s"""
)
def q_pair_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The work of a batch: all pairs wanted, each with its case."""
    wanted = _pair_table(spark, sf).select("base_img_id", "side_img_id")
    return catalog.plan(wanted, q_pair_state(spark, sf), ["base_img_id", "side_img_id"])


@query(f"WITH {fx.IMAGE_SQL}, {fx.STEREO_SQL} SELECT img_name, EXISTS (SELECT 1 FROM pc LEFT JOIN ms ON ms.pc_id = pc.pc_id WHERE ms.base_img_id = image.img_id) AS found FROM image")
def q_cloud_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each image has a registered cloud."""
    image = fx.images(spark, sf)
    have = catalog.clouds_by_base(fx.clouds(spark, sf), fx.stereo(spark, sf), image).select("img_name", F.lit(True).alias("found")).distinct()
    return image.join(have, "img_name", "left").select("img_name", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {fx.IMAGE_SQL}, {fx.STEREO_SQL} SELECT img_name, EXISTS (SELECT 1 FROM ms WHERE base_img_id = img_id) AS found FROM image")
def q_stereo_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each image is the base of a multi-stereo row."""
    return catalog.has_stereo(fx.images(spark, sf), fx.stereo(spark, sf))


@query(
    f"""WITH {fx.IMAGE_SQL}, {fx.STEREO_SQL}, n AS (SELECT img_id AS base_img_id, img_id + 9000 AS new_pc_id FROM image WHERE img_id % 4 = 0)
SELECT ms_id, ms.base_img_id, pc_ready OR new_pc_id IS NOT NULL AS pc_ready, coalesce(new_pc_id, pc_id) AS pc_id FROM ms LEFT JOIN n USING (base_img_id)"""
)
def q_upsert_cloud_status(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-stereo rows after new clouds were registered."""
    i = F.col("img_id")
    new = fx.images(spark, sf).filter(i % 4 == 0).select(i.alias("base_img_id"), (i + 9000).alias("new_pc_id"))
    return catalog.set_cloud(fx.stereo(spark, sf), new)


@query(f"WITH {fx.IMAGE_SQL}, {fx.STEREO_SQL} SELECT * FROM pc WHERE NOT EXISTS (SELECT 1 FROM ms JOIN image ON base_img_id = img_id WHERE ms.pc_id = pc.pc_id AND img_id % 4 = 0)")
def q_delete_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds that stay after those of some bases were deleted."""
    names = fx.images(spark, sf).filter("img_id % 4 = 0").select("img_name")
    return catalog.delete_clouds(fx.clouds(spark, sf), fx.stereo(spark, sf), fx.images(spark, sf), names)


@query(f"WITH {fx.IMAGE_SQL} SELECT (row_number() OVER (ORDER BY img_id) + (SELECT max(img_id) FROM image))::INT AS img_id, img_name FROM image WHERE img_id % 10 = 0")
def q_append_keys(spark: SparkSession, sf: str) -> DataFrame:
    """New images numbered on from the largest key."""
    image = fx.images(spark, sf)
    return catalog.new_keys(image.filter("img_id % 10 = 0"), image, "img_id", ["img_param_id"]).select("img_id", "img_name")


@query(f"WITH {fx.IMAGE_SQL} SELECT img_name AS base FROM image WHERE img_name IN ('img1.jpg', 'img5.jpg', 'img77.jpg')")
def q_base_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Bases named in a comma-separated list (P5)."""
    return catalog.chosen(fx.images(spark, sf).select(F.col("img_name").alias("base")), " img1.jpg, img5.jpg ,img77.jpg")


@query(f"WITH {_PAIR_SQL} SELECT a.img_name AS base, i::INT AS side_idx, 'img' || (a.img_id + i + 1) || '.jpg' AS side FROM image a, range(0, 3) t(i) WHERE a.img_id % 10 < 7")
def q_multiview_expand(spark: SparkSession, sf: str) -> DataFrame:
    """A multiview spec as rows."""
    i = F.col("img_id")
    sides = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("img"), i + k + 1, F.lit(".jpg")))
    return catalog.expand(fx.images(spark, sf).filter(i % 10 < 7).select(F.col("img_name").alias("base"), sides.alias("sides")))


@query(
    f"""WITH {_PAIR_SQL}, n AS (SELECT left(a.img_name, length(a.img_name) - 4) AS b, left(s.img_name, length(s.img_name) - 4) AS s FROM pair JOIN image a ON base_img_id = a.img_id JOIN image s ON side_img_id = s.img_id)
SELECT b || '_' || s || '.tif' AS disparity, b || '_' || s || '_warped_RL.tif' AS warped, b || '_' || s || '_deviations.tif' AS deviations, b || '_' || s || '_mask.tif' AS mask, b || '_rectified.tif' AS rectified FROM n"""
)
def q_cache_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a pair's rasters."""
    names = catalog.cache_names(F.col("base_name"), F.col("side_name"))
    return catalog.named_pairs(_pair_table(spark, sf), fx.images(spark, sf)).select(*[c.alias(k) for k, c in names.items()])


# --- rasters -------------------------------------------------------------------------------


@query(f"WITH {fx.TILE_SQL} SELECT vec_id, y, x, {r('d')} AS d FROM px")
def q_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles as pixel rows."""
    return fx.tiles(spark, sf).select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


_GRID_SQL = """s AS (SELECT i::INT AS i, (CASE WHEN i * 2 + 4 <= 8 THEN i * 2 ELSE 4 END)::INT AS s FROM range(0, 4) t(i)),
grid AS (SELECT a.i * 4 + b.i AS tile, a.i AS ty, b.i AS tx, a.s AS y0, b.s AS x0 FROM s a, s b)"""


@query(f"WITH {_GRID_SQL} SELECT tile, ty, tx, y0, x0 FROM grid")
def q_tile_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins of overlapping tiles."""
    return raster.tile_grid(spark, 8, 8, 4, 4, 2, 2)


@query(
    f"""WITH {fx.TILE_SQL}, {_GRID_SQL}, cut AS (
  SELECT vec_id, tile, y, x, d + tile AS d, y0, x0, CASE WHEN y0 = 0 THEN 0 ELSE y0 + 1 END AS yl, CASE WHEN y0 >= 4 THEN 8 ELSE y0 + 3 END AS yh,
    CASE WHEN x0 = 0 THEN 0 ELSE x0 + 1 END AS xl, CASE WHEN x0 >= 4 THEN 8 ELSE x0 + 3 END AS xh
  FROM px JOIN grid ON y BETWEEN y0 AND y0 + 3 AND x BETWEEN x0 AND x0 + 3)
SELECT vec_id, y, x, {r('arg_max(d, tile)')} AS d FROM cut WHERE y >= yl AND y < yh AND x >= xl AND x < xh GROUP BY vec_id, y, x"""
)
def q_stitch(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles cut, marked by tile, and stitched again."""
    grid = raster.tile_grid(spark, 8, 8, 4, 4, 2, 2)
    cut = raster.cut_tiles(fx.tiles(spark, sf), grid, 4, 4).withColumn("d", F.col("d") + F.col("tile"))
    out = raster.stitch(cut, ["vec_id"], 8, 8, 4, 4, 2, 2)
    return out.select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


@query(f"WITH {fx.TILE_SQL} SELECT vec_id, y // 3 AS y, x // 3 AS x, {r('avg(d)')} AS d FROM px WHERE y < 6 AND x < 6 GROUP BY vec_id, y // 3, x // 3")
def q_block_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Means of 3 x 3 blocks, the remainder left out."""
    out = raster.block_mean(fx.tiles(spark, sf), ["vec_id"], 3, 8, 8)
    return out.select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


@query(f"WITH {fx.TILE_SQL} SELECT vec_id, (y * 2 + i)::INT AS y, (x * 2 + j)::INT AS x, {r('d * 2')} AS d FROM px, range(0, 2) a(i), range(0, 2) b(j)")
def q_upsample(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest upsampling of disparities."""
    out = raster.upsample(fx.tiles(spark, sf), ["vec_id"], 2)
    return out.select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


@query(f"WITH {fx.TILE_SQL} SELECT a.vec_id, a.y, a.x, {r('coalesce(b.d, 0)')} AS d FROM px a LEFT JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 3")
def q_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Horizontal shift with zero fill."""
    out = raster.shift_x(fx.tiles(spark, sf).select("vec_id", "y", "x", "d"), ["vec_id"], 3, 8)
    return out.select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


@query(
    f"""WITH {fx.TILE_SQL}, n AS (SELECT *, CASE WHEN (vec_id + x) % 9 = 0 THEN 'NaN'::DOUBLE ELSE d END AS m FROM px)
SELECT vec_id, y, x, {r("CASE WHEN isnan(m) THEN -192 ELSE m END")} AS filled, {r("greatest(d, 0)")} AS clamped, {r("-d")} AS flipped, {r("d + 12")} AS unshifted,
  round_even((abs(d) - floor(abs(d))) * 255, 0)::INT AS quantised, trunc((abs(d) - floor(abs(d))) * 255)::INT AS cut, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS inverted FROM n"""
)
def q_pixel_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Fills, clamps, flips, quantises and inverts."""
    d = F.col("d")
    nan = F.when((F.col("vec_id") + F.col("x")) % 9 == 0, num(float("nan"))).otherwise(d)
    unit = F.abs(d) - F.floor(F.abs(d))
    return fx.tiles(spark, sf).select(
        "vec_id", "y", "x", rounded(raster.fill_nan(nan)).alias("filled"), rounded(raster.clamp(d)).alias("clamped"), rounded(-d).alias("flipped"),
        rounded(d + num(12)).alias("unshifted"), raster.quantise(unit).alias("quantised"), raster.to_uint8(unit).alias("cut"), raster.invert_validity(F.col("vec_id") % 3).alias("inverted"),
    )


@query("SELECT p_partkey, ((p_partkey % 256 * 19595 + p_size % 256 * 38470 + p_partkey // 256 % 256 * 7471 + 32768) // 65536)::INT AS luma FROM part")
def q_luma(spark: SparkSession, sf: str) -> DataFrame:
    """Luma of integer colours."""
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select("p_partkey", raster.luma(k % 256, F.col("p_size") % 256, F.floor(k / 256) % 256).alias("luma"))


_GATHER_SQL = f"""{fx.TILE_SQL}, l AS (SELECT vec_id, y, x, floor(abs(d) * 16) AS d FROM px), rl AS (SELECT vec_id - 1 AS vec_id, y, x AS at, floor(abs(d) * 16) AS other FROM px),
g AS (SELECT l.*, other, l.d - other AS deviation FROM l LEFT JOIN rl ON l.vec_id = rl.vec_id AND l.y = rl.y AND rl.at = {{}})"""


def _gathered(spark: SparkSession, sf: str, wrap: bool) -> DataFrame:
    px = fx.tiles(spark, sf).withColumn("d", F.floor(F.abs("d") * num(16)).cast("double")).select("vec_id", "y", "x", "d")
    right = px.withColumn("vec_id", F.col("vec_id") - 1)
    return raster.gather(px, right, ["vec_id"], 8, wrap)


@query("WITH " + _GATHER_SQL.format("((trunc(l.x - l.d)::INT % 8) + 8) % 8") + " SELECT vec_id, y, x, d, other, deviation FROM g")
def q_rlcc_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Left disparities beside those they point to in the right map."""
    return _gathered(spark, sf, True)


@query("WITH " + _GATHER_SQL.format("trunc(l.x - l.d)::INT") + " SELECT vec_id, y, x, CASE WHEN abs(deviation) < 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM g")
def q_rlcc_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Right-left consistency (P6, C5); places outside the image are inconsistent."""
    return _gathered(spark, sf, False).select("vec_id", "y", "x", raster.consistent(F.col("deviation")).alias("mask"))


@query(f"WITH {fx.TILE_SQL}, n AS (SELECT label, count(DISTINCT vec_id) AS n FROM px GROUP BY label) SELECT label, y, x FROM px JOIN n USING (label) GROUP BY label, y, x, n HAVING min(CASE WHEN abs(d) < 0.4 THEN 1 ELSE 0 END) = 1 AND count(*) = n")
def q_mask_product(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels that are valid on all sides of a base."""
    px = fx.tiles(spark, sf)
    sides = px.groupBy("label").agg(F.countDistinct("vec_id").alias("n_sides"))
    masks = px.join(sides, "label").withColumn("mask", raster.consistent(F.col("d"), 0.4))
    return raster.common_mask(masks, ["label", "n_sides"], F.col("n_sides")).drop("n_sides")


@query(f"WITH {fx.TILE_SQL} SELECT label, count(*) AS n_pixels, count(*) FILTER (abs(d) < 0.4) AS n_valid FROM px GROUP BY label")
def q_mask_count(spark: SparkSession, sf: str) -> DataFrame:
    """Valid pixels by base."""
    mask = raster.consistent(F.col("d"), 0.4)
    return fx.tiles(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if(mask == num(1)).alias("n_valid"))


@query(
    f"""WITH {fx.TILE_SQL}, m AS (SELECT *, exp(d - max(d) OVER w) AS e FROM px WINDOW w AS (PARTITION BY vec_id, y)), a AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, y) AS att FROM m)
SELECT vec_id, y, x, {r('att')} AS att, {r('sum(att) OVER (PARTITION BY vec_id, x)')} AS column_sum, sum(att) OVER (PARTITION BY vec_id, x) > 0.9 AS valid FROM a"""
)
def q_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Attention along rows and what each column receives."""
    att = raster.attention(fx.tiles(spark, sf), ["vec_id", "y"], "x", "d")
    received = F.sum("att").over(Window.partitionBy("vec_id", "x"))
    return att.select("vec_id", "y", "x", rounded(F.col("att")).alias("att"), rounded(received).alias("column_sum"), (received > num(0.9)).alias("valid"))


# --- points --------------------------------------------------------------------------------

_TRI_SQL = f"""{fx.ROT_SQL}, px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, (l_partkey % 640)::DOUBLE AS x, (l_orderkey % 480)::DOUBLE AS y FROM lineitem),
v AS (SELECT px.*, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS bx, b.y - a.y AS by_, b.z - a.z AS bz, b.x AS cx2, b.y AS cy2, b.z AS cz2,
  """ + ", ".join(f"a.r0{i} * (px.x - 320) + a.r1{i} * (px.y - 240) + a.r2{i} * 1000 AS u{i}, b.r0{i} * (px.x - (300 + q) - 320) + b.r1{i} * (px.y - 240) + b.r2{i} * 1000 AS s{i}" for i in range(3)) + """
  FROM px JOIN rot a ON a.img_id = l_suppkey JOIN rot b ON b.img_id = l_suppkey + 1 WHERE l_suppkey % 10 <> 9),
d AS (SELECT *, u0*u0+u1*u1+u2*u2 AS rr, s0*s0+s1*s1+s2*s2 AS ss, u0*s0+u1*s1+u2*s2 AS rs, bx*u0+by_*u1+bz*u2 AS br, bx*s0+by_*s1+bz*s2 AS bs FROM v),
t AS (SELECT *, (rs*bs - ss*br) / nullif(rs*rs - rr*ss, 0) AS la, (rr*bs - rs*br) / nullif(rs*rs - rr*ss, 0) AS mu FROM d)"""


def _triangulated(spark: SparkSession, sf: str) -> DataFrame:
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pair = fx.pairs(fx.cameras(spark, sf))
    rows = li.join(pair, F.col("l_suppkey") == F.col("left_img_id"))
    k, x, y = Mat.of("left_camera_matrix"), (F.col("l_partkey") % 640).cast("double"), (F.col("l_orderkey") % 480).cast("double")
    left = camera.ray(x, y, k, Mat.of("left_rotation_matrix"))
    right = camera.ray(x - (F.col("l_quantity") + num(300)), y, k, Mat.of("right_rotation_matrix"))
    rows = rows.withColumns({f"u{i}": c for i, c in enumerate(left)} | {f"s{i}": c for i, c in enumerate(right)})
    point = midpoint(camera.centre("left_"), [F.col(f"u{i}") for i in range(3)], camera.centre("right_"), [F.col(f"s{i}") for i in range(3)])
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for c, n in zip(point, "XYZ", strict=True)])


def _point_sql(a: str, i: int) -> str:
    return f"(a{a} + la * u{i} + c{a}2 + mu * s{i}) / 2"


@query(f"WITH {_TRI_SQL} SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"floor(({_point_sql(a, i)}) * 1e4 + 0.5) / 1e4 AS p{a}" for i, a in enumerate("xyz")) + " FROM t")
def q_triangulate(spark: SparkSession, sf: str) -> DataFrame:
    """Midpoints of pixel rays of neighbouring cameras."""
    return _triangulated(spark, sf).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *[(F.floor(F.col(n) * num(1e4) + num(0.5)) / num(1e4)).alias(f"p{n.lower()}") for n in "XYZ"])


@query(f"WITH {_TRI_SQL} SELECT l_suppkey, l_partkey % 640 AS x, count(*) AS views, " + ", ".join(f"floor(avg({_point_sql(a, i)}) * 1e3 + 0.5) / 1e3 AS p{a}" for i, a in enumerate("xyz")) + " FROM t GROUP BY l_suppkey, l_partkey % 640")
def q_mean_point(spark: SparkSession, sf: str) -> DataFrame:
    """Mean points over sides."""
    by = [F.col("l_suppkey"), (F.col("l_partkey") % 640).alias("x")]
    return _triangulated(spark, sf).groupBy(*by).agg(F.count(F.lit(1)).alias("views"), *[(F.floor(F.avg(n) * num(1e3) + num(0.5)) / num(1e3)).alias(f"p{n.lower()}") for n in "XYZ"])


@query("SELECT l_suppkey AS base, min(l_extendedprice) AS x0, min(l_quantity) AS y0, max(l_extendedprice) AS x1, max(l_quantity) AS y1, count(*) AS n_points FROM lineitem GROUP BY l_suppkey")
def q_cloud_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Footprint and size of clouds."""
    f = F.col("footprint")
    return triangulation.extent(fx.points(spark, sf)).select("base", f[0][0].alias("x0"), f[0][1].alias("y0"), f[2][0].alias("x1"), f[2][1].alias("y1"), "n_points")


@query("SELECT printf('%f %f %f %d %d %d %d', l_extendedprice - s.x, l_quantity - s.y, l_discount, l_partkey % 256, l_orderkey % 256, l_suppkey % 256, 3) AS line FROM lineitem, (SELECT min(l_extendedprice) AS x, min(l_quantity) AS y FROM lineitem) s")
def q_ply_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of a cloud as text, shifted, with views."""
    pts = fx.points(spark, sf)
    shifts = pts.agg(F.min("X").alias("x_shift"), F.min("Y").alias("y_shift"))
    out = triangulation.shift_to_origin(pts, shifts)
    return out.select(triangulation.ply_line(*[F.col(c) for c in "XYZrgb"], F.lit(3)).alias("line"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS base, p_size % 256 AS r, (p_retailprice::BIGINT % 256)::INT AS g, (l_partkey % 256)::INT AS b FROM lineitem JOIN part ON l_partkey = p_partkey")
def q_colour_join(spark: SparkSession, sf: str) -> DataFrame:
    """Points with the colour of their pixel."""
    key = F.col("p_partkey")
    pixels = fx.table(spark, sf, "part").select(key.alias("l_partkey"), (F.col("p_size") % 256).alias("r"), (F.rint("p_retailprice").cast("long") % 256).cast("int").alias("g"), (key % 256).cast("int").alias("b"))
    pts = fx.points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "base")
    return triangulation.colour(pts, pixels, ["l_partkey"])


def _estimates(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_type", F.col("value").alias("gt"), (F.col("value") * num(0.9) + num(1)).alias("est"), (F.col("user_id") % 10 != 0).alias("mask"))


_EST_SQL = "e AS (SELECT event_type, value AS gt, value * 0.9::DOUBLE + 1 AS est FROM events WHERE user_id % 10 <> 0)"


@query(f"WITH {_EST_SQL} SELECT event_type, {r('avg(CASE WHEN abs(gt - est) > 3 AND abs(gt - est) > 0.05::DOUBLE * abs(gt) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS d1 FROM e GROUP BY event_type")
def q_metrics_d1(spark: SparkSession, sf: str) -> DataFrame:
    """Outlier rate by image."""
    return metrics.d1(_estimates(spark, sf), "event_type").withColumn("d1", rounded(F.col("d1")))


@query(f"WITH {_EST_SQL} SELECT event_type, {r('avg(abs(gt - est))')} AS epe FROM e GROUP BY event_type")
def q_metrics_epe(spark: SparkSession, sf: str) -> DataFrame:
    """End-point error by image."""
    return metrics.epe(_estimates(spark, sf), "event_type").withColumn("epe", rounded(F.col("epe")))


# --- footprints ----------------------------------------------------------------------------

_BOX = ("x0", "y0", "x1", "y1")


def _boxes(spark: SparkSession, sf: str, prefix: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    corners = (x - num(70), y - num(50), x + num(70), y + num(50))
    return fx.cameras(spark, sf).select(F.col("img_id").alias(f"{prefix}id"), *[c.alias(f"{prefix}{n}") for c, n in zip(corners, _BOX, strict=True)])


_OVERLAP_SQL = f"""{fx.CAMERA_SQL}, box AS (SELECT img_id, x - 70 AS x0, y - 50 AS y0, x + 70 AS x1, y + 50 AS y1 FROM cam),
o AS (SELECT a.img_id AS base, b.img_id AS side, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS ratio
  FROM box a JOIN box b ON a.img_id <> b.img_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)"""


@query(f"WITH {_OVERLAP_SQL} SELECT base, side, {r('ratio')} AS ratio FROM o")
def q_overlap_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each footprint that its neighbours' cover, by a grid join."""
    a, b = ([F.col(f"{p}{n}") for n in _BOX] for p in ("a_", "b_"))
    test = (F.col("a_id") != F.col("b_id")) & rings.box_touches(a, b)
    met = spatial.spatial_join(_boxes(spark, sf, "a_"), _boxes(spark, sf, "b_"), [f"a_{n}" for n in _BOX], [f"b_{n}" for n in _BOX], 140.0, test)
    ratio = rings.box_overlap(a, b) / ((a[2] - a[0]) * (a[3] - a[1]))
    return met.select(F.col("a_id").alias("base"), F.col("b_id").alias("side"), rounded(ratio).alias("ratio"))


@query(
    f"""WITH {fx.CAMERA_SQL}, own AS (SELECT a.img_id AS base, greatest(a.x - 70, b.x - 70) + 10 AS x0, greatest(a.y - 50, b.y - 50) + 10 AS y0, least(a.x + 70, b.x + 70) - 10 AS x1, least(a.y + 50, b.y + 50) - 10 AS y1
  FROM cam a JOIN cam b ON b.img_id = a.img_id + 1 WHERE a.img_id % 10 <> 9)
SELECT base, string_agg(img_id::VARCHAR, ',' ORDER BY img_id) AS overlapping FROM own JOIN cam ON cam.x - 70 <= x1 AND x0 <= cam.x + 70 AND cam.y - 50 <= y1 AND y0 <= cam.y + 50 WHERE x0 <= x1 AND y0 <= y1 GROUP BY base"""
)
def q_spatial_join(spark: SparkSession, sf: str) -> DataFrame:
    """Images that touch the eroded common footprint of each base and its side."""
    a = _boxes(spark, sf, "a_").withColumn("next", F.col("a_id") + 1).filter(F.col("a_id") % 10 != 9)
    both = a.join(_boxes(spark, sf, "b_"), F.col("next") == F.col("b_id"))
    margin = num(10)
    own = both.select(F.col("a_id").alias("base"), *[((F.greatest if i < 2 else F.least)(f"a_{n}", f"b_{n}") + (margin if i < 2 else -margin)).alias(f"o_{n}") for i, n in enumerate(_BOX)])
    own = own.filter((F.col("o_x0") <= F.col("o_x1")) & (F.col("o_y0") <= F.col("o_y1")))
    o, c = ([F.col(f"{p}{n}") for n in _BOX] for p in ("o_", "c_"))
    met = spatial.spatial_join(own, _boxes(spark, sf, "c_"), [f"o_{n}" for n in _BOX], [f"c_{n}" for n in _BOX], 140.0, rings.box_touches(o, c))
    return met.groupBy("base").agg(F.array_join(F.sort_array(F.collect_list("c_id")).cast("array<string>"), ",").alias("overlapping"))


@query()
def q_rotated_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of neighbours' true footprints, general convex rings."""
    pair = fx.pairs(_footprints(spark, sf).select("img_id", "geobound"))
    ratio = rings.overlap_ratio("left_geobound", "right_geobound")
    return pair.select(F.col("left_img_id").alias("base"), F.col("right_img_id").alias("side"), rounded(ratio).alias("ratio"))


_RECT = {"r": "q", "h1": "h", "h2": "k"}


@query(
    f"WITH {rectify_sql.layers(_HEIGHT_SQL)} SELECT base, side, "
    + ", ".join(f"{r(f'{q}{i}{j}')} AS {n}{i}{j}" for n, q in _RECT.items() for i in range(3) for j in range(3))
    + ", "
    + ", ".join(f"{r(c)} AS {c}" for c in ("x_min", "x_max", "y_min", "y_max"))
    + ", out_rows, out_cols, shift FROM rect"
)
def q_rectification(spark: SparkSession, sf: str) -> DataFrame:
    """Rectifying rotation, homographies, bounds and disparity shift of neighbours."""
    height = _height(spark, sf)
    p = camera.rectify_pairs(fx.pairs(fx.cameras(spark, sf))).join(F.broadcast(height))
    p = p.withColumn("shift", camera.disparity_shift(F.col("mean_flying_height")))
    m = [rounded(F.col(h)[i][j]).alias(f"{h.lower()}{i}{j}") for h in ("R", "H1", "H2") for i in range(3) for j in range(3)]
    return p.select(F.col("left_img_id").alias("base"), F.col("right_img_id").alias("side"), *m, *[rounded(F.col(c)).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")], "out_rows", "out_cols", "shift")


@query(f"WITH {fx.CAMERA_SQL}, pair AS (SELECT img_id AS img_pair_id, img_id + 7000 AS rect_param_id FROM cam WHERE img_id % 10 <> 9), prm AS (SELECT img_id + 7000 AS rect_param_id, c AS f, cx FROM cam WHERE img_id % 3 <> 0) SELECT img_pair_id, rect_param_id, f, cx FROM pair JOIN prm USING (rect_param_id)")
def q_rectification_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rectification of pairs."""
    i, k = F.col("img_id"), F.col("camera_matrix")
    cams = fx.cameras(spark, sf)
    pair = cams.filter(i % 10 != 9).select(i.alias("img_pair_id"), (i + 7000).alias("rect_param_id"))
    params = cams.filter(i % 3 != 0).select((i + 7000).alias("rect_param_id"), k[0][0].alias("f"), k[0][2].alias("cx"))
    return catalog.rectification(pair, params).select("img_pair_id", "rect_param_id", "f", "cx")


# --- sources, sinks and the catalog, written and read back --------------------------------------


@query(f"WITH {fx.CAMERA_SQL} SELECT img_name, x, y, z, c, cx AS x0, -cy AS y0, {', '.join(f'{r(f"degrees({a})")} AS {n}' for a, n in (('o', 'omega'), ('p', 'phi'), ('k', 'kappa')))} FROM cam")
def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras as calibration text, read again."""
    path = new_folder(spark, "calibration")
    names = {v: k for k, v in readers.CALIBRATION.items()}
    own = ["img_name", "x", "y", "z", "c", "x0", "y0", "omega", "phi", "kappa"]
    rows = fx.cameras(spark, sf).select(*own, *[F.lit(0).alias(n) for n in names if n not in own])
    line = F.concat_ws("  ", *[F.col(n) for n in names])
    head = spark.createDataFrame([("  ".join(names[n] for n in names),)], "value string")
    head.unionByName(rows.select(line.alias("value"))).write.text(path)
    read = readers.read_calibration(spark, path)
    return read.select(*own[:7], *[rounded(F.col(c)).alias(c) for c in own[7:]])


@query("SELECT printf('%f', l_extendedprice)::FLOAT::DOUBLE AS x, printf('%f', l_quantity)::FLOAT::DOUBLE AS y, printf('%f', l_discount)::FLOAT::DOUBLE AS z FROM lineitem")
def q_ply_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """A cloud written, appended to, joined into one file, and read again."""
    path = new_folder(spark, "cloud")
    points = fx.points(spark, sf)
    n = writers.write_ply(points.filter("l_linenumber <= 3"), path)
    writers.append_ply(points.filter("l_linenumber > 3"), path, n)
    writers.join_ply(spark, path, f"{path}/whole.ply")
    return readers.read_ply(spark, f"{path}/whole.ply")


@query(f"WITH {fx.TILE_SQL} SELECT vec_id, y, x, {r('d')} AS d FROM px")
def q_raster_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Rasters cached in two goes, of which the second leaves the first's, and read again."""
    path = new_folder(spark, "rasters")
    floats = F.pandas_udf(lambda many: many.map(lambda e: np.asarray(e, "<f4").tobytes()), T.BinaryType())
    rows = _tile_arrays(spark, sf).select((F.col("vec_id") % 4).cast("string").alias("base"), F.lit("s").alias("side"), F.lit(0).alias("y0"), F.col("vec_id").cast("int").alias("x0"), F.lit(8).alias("h"), F.lit(8).alias("w"), floats("e").alias("data"))
    writers.write_raster(rows.filter("base < '2'"), path)
    writers.write_raster(rows.filter("base >= '2'"), path)
    values = F.pandas_udf(lambda many: many.map(lambda b: np.frombuffer(b, "<f4")), T.ArrayType(T.FloatType()))
    read = writers.cached(spark, path, ["base", "side"], "y0 int, x0 int, h int, w int, data binary").select(F.col("x0").cast("long").alias("vec_id"), values("data").alias("e"))
    return raster.explode_tile(read, "e", fx.SIDE, ["vec_id"]).select("vec_id", "y", "x", rounded(F.col("d")).alias("d"))


def _built(spark: SparkSession, sf: str) -> catalog.Catalog:
    from ..operators.reconstruction import build_catalog

    las = fx.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("z"))
    return build_catalog(spark, new_folder(spark, "catalog"), fx.cameras(spark, sf).withColumn("ord", F.col("img_id")).drop("img_id"), las)


@query(
    f"WITH {_FOOT_SQL} SELECT row_number() OVER (ORDER BY img_id)::INT AS img_id, img_name, nrows, ncols, x, y, z, "
    + ", ".join(f"{r(f'{a}{i}')} AS {a}{i}" for i in range(4) for a in "xy")
    + f", {r('r00')} AS r00, {r('zf')} AS mean_flying_height, (SELECT min(x) FROM cam) AS x_shift FROM foot"
)
def q_catalog_build(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog built from cameras and ground heights, read again."""
    cat = _built(spark, sf)
    g = F.col("geobound")
    rows = cat.read("image").join(cat.read("image_param"), "img_param_id").join(F.broadcast(cat.read("globals")))  # one row
    return rows.select(
        "img_id", "img_name", "nrows", "ncols", "x", "y", "z", *[rounded(g[i][a]).alias(f"{'xy'[a]}{i}") for i in range(4) for a in range(2)],
        rounded(F.col("rotation_matrix")[0][0]).alias("r00"), rounded(F.col("mean_flying_height")).alias("mean_flying_height"), "x_shift",
    )


@query(
    f"WITH {rectify_sql.layers(_HEIGHT_SQL)}, known AS (SELECT img_id, row_number() OVER (ORDER BY img_id) AS n FROM cam) "
    f"SELECT row_number() OVER (ORDER BY a.n, b.n)::INT AS img_pair_id, a.n::INT AS base_img_id, b.n::INT AS side_img_id, {r('q00')} AS r00, {r('h02')} AS h102, {r('k12')} AS h212, ceil(x_min) AS shift_x, c AS f "
    "FROM rect JOIN known a ON a.img_id = base JOIN known b ON b.img_id = side"
)
def q_insert_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs added to a catalog with their rectification, in two goes, and read again."""
    from ..operators.reconstruction import insert_pairs

    cat = _built(spark, sf)
    image = cat.read("image")
    number = F.regexp_extract("img_name", "[0-9]+", 0).cast("int")
    ids = image.select(F.col("img_id"), number.alias("n"))
    pairs = ids.filter("n % 10 <> 9").select(F.col("img_id").alias("base_img_id"), (F.col("n") + 1).alias("n")).join(ids.withColumnRenamed("img_id", "side_img_id"), "n").drop("n")
    insert_pairs(cat, pairs)
    insert_pairs(cat, pairs)  # all are known: nothing is added
    rows = cat.read("image_pair").join(cat.read("rectification_param"), "rect_param_id")
    m = lambda h, i, j: rounded(F.col(h)[i][j])
    return rows.select("img_pair_id", "base_img_id", "side_img_id", m("r", 0, 0).alias("r00"), m("h1", 0, 2).alias("h102"), m("h2", 1, 2).alias("h212"), F.col("h_shift")[0][2].alias("shift_x"), F.col("k")[0][0].alias("f"))


# --- kernels (no SQL twin) -------------------------------------------------------------------


def _tile_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return fx.whole_tiles(spark, sf)


@query()
def q_clean_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Validity masks after removal of specks, filling of holes and closing."""
    from ..operators.morphology import clean_masks

    side = F.lit(fx.SIDE)
    mask = F.transform("e", lambda d: F.when(F.abs(d) < 0.4, 1).otherwise(0))
    out = clean_masks(_tile_arrays(spark, sf).select("vec_id", side.alias("h"), side.alias("w"), mask.alias("mask")), "vec_id")
    return out.select("vec_id", F.posexplode("mask").alias("pos", "mask")).filter("mask = 1").select("vec_id", "pos")


_WARP = ((1.0, 0.1, 0.5), (-0.1, 1.0, 0.25), (0.001, 0.0, 1.0))
_WARP_SQL = ", ".join(f"{' + '.join(f'{m}::DOUBLE * {n}' for m, n in zip(row, ('x', 'y', '1'), strict=True))} AS {name}" for row, name in zip(_WARP, "uvw", strict=True))


@query(
    f"""WITH {fx.TILE_SQL}, o AS (SELECT y::INT AS y, x::INT AS x, {_WARP_SQL} FROM range(0, 10) a(y), range(0, 9) b(x)),
place AS (SELECT y, x, floor(u / w)::INT AS x0, floor(v / w)::INT AS y0, u / w - floor(u / w) AS fx, v / w - floor(v / w) AS fy FROM o),
near AS (SELECT y, x, y0 + dy AS sy, x0 + dx AS sx, (CASE dx WHEN 0 THEN 1 - fx ELSE fx END) * (CASE dy WHEN 0 THEN 1 - fy ELSE fy END) AS weight, 2 * dy + dx AS k FROM place, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(dy, dx)),
part AS (SELECT vec_id, near.y, near.x, k, d * weight AS t FROM near JOIN px ON px.y = sy AND px.x = sx),
total AS (SELECT vec_id, y, x, sum(t ORDER BY k) AS t FROM part GROUP BY vec_id, y, x)
SELECT v.vec_id, o.y, o.x, {r('coalesce(t, 0)::FLOAT::DOUBLE')} AS d FROM (SELECT DISTINCT vec_id FROM px) v CROSS JOIN o LEFT JOIN total USING (vec_id, y, x)"""
)
def q_warp(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of tiles through a projective map, by output tiles."""
    from ..operators.warping import warp_tiles

    floats = F.pandas_udf(lambda many: many.map(lambda e: np.asarray(e, "<f4").tobytes()), T.BinaryType())  # as readers give them
    name = F.col("vec_id").cast("string")
    tiles = _tile_arrays(spark, sf).select(name.alias("img"), F.lit(0).alias("ty"), F.lit(0).alias("tx"), F.lit(8).alias("h"), F.lit(8).alias("w"), floats("e").alias("data"))
    matrix = F.array(*[F.array(*map(num, row)) for row in _WARP])
    maps = tiles.select("img", F.col("img").alias("out"), matrix.alias("matrix"), F.lit(10).alias("rows"), F.lit(9).alias("cols"))
    values = F.pandas_udf(lambda many: many.map(lambda b: np.frombuffer(b, "<f4")), T.ArrayType(T.FloatType()))
    out = warp_tiles(tiles, maps, 8).select(F.col("out").cast("long").alias("vec_id"), "ty", "tx", "w", F.posexplode(values("data")).alias("pos", "d"))
    at = [(F.col("ty") * 8 + F.floor(F.col("pos") / F.col("w"))).cast("int").alias("y"), (F.col("tx") * 8 + F.col("pos") % F.col("w")).cast("int").alias("x")]
    return out.select("vec_id", *at, rounded(F.col("d").cast("double")).alias("d"))


@query()
def q_semi_global(spark: SparkSession, sf: str) -> DataFrame:
    """Disparity of tile pairs by semi-global matching."""
    from ..estimators import estimate

    def picture(e, shift: int) -> bytes:
        small = np.roll(np.abs(np.asarray(e).reshape(8, 8)), -shift, axis=1).clip(0, 1)
        return np.kron(small, np.ones((6, 6)))[..., None].repeat(3, axis=2).astype("<f4").tobytes()

    def image(shift: int):
        return F.pandas_udf(lambda many: many.map(lambda e: picture(e, shift)), T.BinaryType())

    rows = _tile_arrays(spark, sf).select(F.col("vec_id").alias("tile_id"), F.lit(48).alias("h"), F.lit(48).alias("w"), image(0)("e").alias("left"), image(1)("e").alias("right"))
    return estimate(rows, "SGM", low=0, high=3).select("tile_id", "h", "w", F.crc32("disparity").alias("disparity"), F.crc32("mask").alias("mask"))


@query()
def q_multiview_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Coloured points of bases with up to two sides, through rectified space, where every side's mask and
    eroded footprint hold (C6: G5, G9, G12, G14, G16, A6, A7, J8, J11)."""
    from ..operators import reconstruction

    views, geometry, images, pairs_ = multiview_inputs(spark, sf)
    out = reconstruction.clouds(views, geometry, images, pairs_, 5.0)
    return out.select("base", *[(F.floor(F.col(c) * num(1e3) + num(0.5)) / num(1e3)).alias(c) for c in triangulation.WORLD], "views", "r", "g", "b")


def multiview_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Views, geometry, images and pairs of bases that see their neighbours on both sides.

    A base's image is one 8 x 8 block of its vector, in a place that moves with its number. The cameras
    fly four times as high as elsewhere, so that a base shares ground with both neighbours.
    """
    height = _height(spark, sf).select((F.col("mean_flying_height") * 4).alias("mean_flying_height"))
    cams = fx.cameras(spark, sf).join(F.broadcast(height)).withColumn("geobound", camera.footprint(F.col("mean_flying_height"))).drop("mean_flying_height")
    one = fx.pairs(cams)
    names = {c: c.replace("left_", "right_") if c.startswith("left_") else c.replace("right_", "left_") for c in one.columns}
    both = one.unionByName(one.select(*[F.col(c).alias(n) for c, n in names.items()]))
    p = camera.rectify_pairs(both).join(F.broadcast(height))  # one row
    shift = Mat.of("H_shift")
    p = p.withColumns({"left_map": (Mat.of("H1") @ shift).held(), "right_map": (Mat.of("H2") @ shift).held()})
    geometry = p.withColumns({"base": F.col("left_img_id").cast("string"), "side": F.col("right_img_id").cast("string")})
    pairs_ = geometry.select("base", "side")
    i = F.col("vec_id")
    floats = F.pandas_udf(lambda many: many.map(lambda e: np.asarray(e, "<f4").tobytes()), T.BinaryType())
    block = [(100 + 8 * (i % 40)).cast("int").alias("y0"), (200 + 8 * (i % 50)).cast("int").alias("x0"), F.lit(fx.SIDE).alias("h"), F.lit(fx.SIDE).alias("w")]
    px = _tile_arrays(spark, sf).select(i.cast("string").alias("base"), *block, "e")
    # ground at the flying height lies at a disparity near focal length * base / height
    met = geometry.select("base", "side", "mean_flying_height").join(px, "base")
    two = F.flatten(F.transform("e", lambda d: F.array((num(fx.FOCAL * 40) / F.col("mean_flying_height") + d).cast("float"), F.when(F.abs(d) < 0.6, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))))
    views = met.select("base", "side", "y0", "x0", "h", "w", floats(two).alias("data"))
    three = F.flatten(F.transform("e", lambda d: F.array(*[(F.abs(d) * num(k) % num(1)).cast("float") for k in (1, 7, 13)])))
    images = px.select(F.col("base").alias("img"), "y0", "x0", "h", "w", floats(three).alias("data"))
    return views, geometry, images, pairs_
