"""The composite operators: pair disparities, consistency masks, clouds, and whole batches.

All bases of a batch are rows of one DataFrame; what is already known is found by one join. Rasters
pass from step to step as blocks (see :mod:`.warping`), dealt by pair and window, so no task holds an
image. What a pair or a base costs most is cached by its names, and found there the next time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..estimators import estimate
from ..functions import camera, rings
from ..functions.camera import with_matrices
from ..functions.linalg import Mat, num
from ..sources.writers import cached, write_clouds, write_raster
from ..staging import stage
from . import catalog, raster, spatial, triangulation, warping
from .catalog import Catalog

#: Rows of a strip in which two disparities of a pair are compared.
STRIP = 64
BLOCKS = "y0 int, x0 int, h int, w int, data binary"
POINTS = "east double, north double, height double, r int, g int, b int, views int"


def build_catalog(spark: SparkSession, root: str, cameras: DataFrame, las: DataFrame, epsg: int = 32632, downsample: float = 1.0) -> Catalog:
    """Fills a new catalog from calibration rows (with nrows and ncols) and ground heights.

    A complete catalog is left as it is.
    """
    from ..functions.camera import footprint, ground_sampling

    cat = Catalog(spark, root)
    if cat.exists():
        return cat
    cat.create()
    height = triangulation.mean_height(cameras.select("z"), las)
    rows = with_matrices(cameras, downsample).join(F.broadcast(height))  # one row
    rows = rows.withColumn("geobound", footprint(F.col("mean_flying_height")))
    params = cat.append("image_param", rows, "img_param_id", ["ord"])
    cat.append("image", params.select("img_name", "img_param_id", "ord"), "img_id", ["ord"])
    gsd = F.min_by(ground_sampling(F.col("geobound"), F.col("nrows"), F.col("ncols")), "ord")
    cat.write("globals", rows.agg(gsd.alias("estimated_gsd"), F.first("mean_flying_height").alias("mean_flying_height"), F.lit(epsg).alias("epsg"), F.min("x").alias("x_shift"), F.min("y").alias("y_shift")))
    return cat


def side_by_side(cat: Catalog, pairs: DataFrame) -> DataFrame:
    """(base_img_id, side_img_id) with all parameters of both images as left_ and right_."""
    params = cat.read("image").select("img_id", "img_param_id").join(cat.read("image_param"), "img_param_id").drop("img_param_id")
    out = pairs
    for side, prefix in (("base_img_id", "left_"), ("side_img_id", "right_")):
        named = params.select(*[F.col(c).alias(side if c == "img_id" else f"{prefix}{c}") for c in params.columns])
        out = out.join(named, side)
    return out


def insert_pairs(cat: Catalog, pairs: DataFrame) -> DataFrame:
    """Adds pairs (base_img_id, side_img_id) that the catalog lacks, with rectification and overlap.

    Returns the new rows with their keys and parameters (W5).
    """
    known = cat.read("image_pair").select("base_img_id", "side_img_id")
    new = pairs.select("base_img_id", "side_img_id").distinct().join(known, ["base_img_id", "side_img_id"], "left_anti")
    rows = camera.rectify_pairs(side_by_side(cat, new)).withColumn("overlap", rings.overlap_ratio("left_geobound", "right_geobound"))
    rows = rows.withColumnsRenamed({"H1": "h1", "H2": "h2", "H_shift": "h_shift", "R": "r", "left_camera_matrix": "k"})
    order = ["base_img_id", "side_img_id"]
    kept = cat.append("rectification_param", rows.select(*order, "overlap", "h1", "h2", "h_shift", "k", "r"), "rect_param_id", order)
    cat.append("image_pair", kept.select(*order, "overlap", "rect_param_id"), "img_pair_id", order)
    return kept


def insert_stereo(cat: Catalog, spec: DataFrame, buffer_px: float = 300.0, cell: float | None = None) -> DataFrame:
    """Adds multi-stereo rows of bases (base_img_id, side_img_ids) with the images that their common
    footprint, eroded by the buffer on the ground, touches (W6, J7, A9, A16).

    Footprints' boxes meet in grid cells before the exact test. A base whose eroded footprint is empty
    has a row without images.
    """
    images = cat.read("image").select("img_id", "img_param_id").join(cat.read("image_param").select("img_param_id", "geobound"), "img_param_id")
    members = spec.select("base_img_id", F.posexplode(F.concat(F.array("base_img_id"), "side_img_ids")).alias("pos", "img_id")).join(images, "img_id")
    gsd = catalog.setting(cat.read("globals"), "estimated_gsd")
    feet = members.groupBy("base_img_id").agg(F.sort_array(F.collect_list(F.struct("pos", "geobound"))).alias("m")).join(F.broadcast(gsd))
    feet = feet.withColumn("ring", rings.common_area(F.transform("m", lambda x: x["geobound"]), F.col("estimated_gsd") * num(buffer_px)))

    def box(ring: str, prefix: str) -> list:
        def axis(a: int):
            return F.transform(ring, lambda p: p[a])

        sides = [axis(0), axis(1)]
        return [c.alias(f"{prefix}{i}") for i, c in enumerate((F.array_min(sides[0]), F.array_min(sides[1]), F.array_max(sides[0]), F.array_max(sides[1])))]

    left = feet.filter(F.size("ring") > 0).select("base_img_id", "ring", *box("ring", "a"))
    right = images.select("img_id", "geobound", *box("geobound", "b"))
    size = cell or float(right.agg(F.max(F.greatest(F.col("b2") - F.col("b0"), F.col("b3") - F.col("b1")))).first()[0] or 1.0)
    a, b = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    near = spatial.spatial_join(left, right, a, b, size, rings.box_touches([F.col(c) for c in a], [F.col(c) for c in b]))
    touching = near.withColumn("hit", rings.touches("ring", "geobound")).filter("hit")
    found = touching.groupBy("base_img_id").agg(F.sort_array(F.collect_list("img_id")).alias("overlapping_bounds"))
    rows = spec.select("base_img_id").distinct().join(found, "base_img_id", "left").withColumn("overlapping_bounds", F.coalesce("overlapping_bounds", F.array().cast("array<int>")))
    rows = rows.withColumns({"pc_ready": F.lit(False), "pc_id": F.lit(None).cast("int")})
    return cat.append("multi_stereo", rows, "ms_id", ["base_img_id"])


def rectifying_maps(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Maps for :func:`.warping.warp_tiles` that rectify both images of pairs.

    ``pairs`` is the result of ``camera.rectify_pairs`` with ``shift``, and columns with the images'
    names. The right image is shifted in the same pass, so it is sampled once.
    """
    shifted = Mat([[num(1), num(0), -F.col("shift").cast("double")], [num(0), num(1), num(0)], [num(0), num(0), num(1)]])
    out = pairs.withColumns({"_left": (Mat.of("H1") @ Mat.of("H_shift")).held(), "_right": (Mat.of("H2") @ (Mat.of("H_shift") @ shifted)).held()})
    pair = F.concat_ws("|", left, right)
    both = F.array(*[F.struct(F.col(img).alias("img"), F.concat(pair, F.lit(f"|{side}")).alias("out"), F.col(f"_{side}").alias("matrix")) for img, side in ((left, "left"), (right, "right"))])
    return out.select(F.explode(both).alias("m"), F.col("out_rows").alias("rows"), F.col("out_cols").alias("cols")).select("m.*", "rows", "cols")


def register_clouds(cat: Catalog, points: DataFrame, names: DataFrame) -> DataFrame:
    """Adds clouds to the catalog and marks their bases ready; ``names`` has (base, img_name, base_img_id).

    A base's earlier cloud is replaced. Returns the new rows with their keys.
    """
    old = cat.read("point_cloud")
    gone = catalog.delete_clouds(old, cat.read("multi_stereo"), cat.read("image"), names.select("img_name"))
    cat.write("point_cloud", gone)
    rows = triangulation.extent(points).join(names, "base").withColumn("pc_name", catalog.stem(F.col("img_name")))
    added = cat.append("point_cloud", rows, "pc_id", ["base_img_id"])
    marks = added.select("base_img_id", F.col("pc_id").alias("new_pc_id"))
    cat.write("multi_stereo", catalog.set_cloud(cat.read("multi_stereo"), marks))
    return added


def pair_geometry(cat: Catalog, pairs: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(base, side) -> rectification of the pairs, their disparity shift, sizes, and maps from rectified to
    original places: ``left_map`` and ``right_map``, and ``shifted_map`` with the shift (C2)."""
    ids = cat.read("image").select("img_id", "img_name")
    for side in ("base", "side"):
        pairs = pairs.join(ids.select(F.col("img_id").alias(f"{side}_img_id"), F.col("img_name").alias(side)), side)
    height = catalog.setting(cat.read("globals"), "mean_flying_height")
    out = camera.rectify_pairs(side_by_side(cat, pairs)).join(F.broadcast(height))  # one row
    out = out.withColumn("shift", camera.disparity_shift(F.col("mean_flying_height"), ratio))
    out = out.withColumns({"left_map": (Mat.of("H1") @ Mat.of("H_shift")).held(), "right_map": (Mat.of("H2") @ Mat.of("H_shift")).held()})
    moved = Mat([[num(1), num(0), -F.col("shift").cast("double")], [num(0), num(1), num(0)], [num(0), num(0), num(1)]])
    out = out.withColumn("shifted_map", (Mat.of("right_map") @ moved).held()).withColumn("left_back", Mat.of("left_map").inverse().held())
    # rows of pairs are few beside those of their pixels; written, so that no later plan repeats the products
    return stage(out, "pair-geometry")


def axis_tiles(n: Column, tile: int, overlap: int) -> Column:
    """Array of (at, size, low, high) along an axis of ``n`` places: the tiles of :func:`.raster.tile_starts`,
    each once, with the range that it owns in the stitched image (R4, R5)."""
    if not 0 <= overlap < tile:
        raise ValueError("an overlap shorter than the tile")
    half = overlap // 2
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1, F.lit(tile - overlap)), lambda s: F.least(s, n - tile)))
    starts = F.when(n <= tile, F.array(F.lit(0))).otherwise(many)

    def one(s: Column, i: Column) -> Column:
        after = F.get(starts, i + 1)
        return F.struct(s.alias("at"), F.least(n, F.lit(tile)).alias("size"), F.when(i == 0, 0).otherwise(s + half).alias("low"), F.coalesce(after + half, n).alias("high"))

    return F.transform(starts, one)


def _name(*parts: str) -> Column:
    return F.concat_ws("\x1f", *[F.col(p) if p in ("base", "side") else F.lit(p) for p in parts])


def _as_pairs(blocks: DataFrame, *more: str) -> DataFrame:
    """Blocks of outputs named by :func:`_name`, with base and side again."""
    return blocks.withColumn("p_", F.split("out", "\x1f")).withColumns({"base": F.col("p_")[0], "side": F.col("p_")[1]}).select("base", "side", *warping.BLOCK, *more)


def image_blocks(tiles: DataFrame) -> DataFrame:
    """Tile rows of a reader as blocks (img, y0, x0, h, w, data) of three bands; grey ones are repeated."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = np.asarray(row.column("data")[0].values, "<f4")
                if row.column("bands")[0].as_py() == 1:
                    data = data.repeat(3)
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("img", "y0", "x0", "h", "w")], pa.array([data.tobytes()], pa.binary())], ["img", *warping.BLOCK])

    return tiles.select("img", "y0", "x0", "h", "w", "bands", "data").mapInArrow(run, f"img string, {BLOCKS}")


def disparities(images: DataFrame, geometry: DataFrame, settings: Settings, cell: int, **options) -> DataFrame:
    """(base, side, y0, x0, h, w, data): disparity of rectified base images, in blocks that cover them.

    Tiles of both images are sampled straight from the originals (R1, R3 and R4 in one), the estimator
    runs on each pair of tiles, and a tile keeps the range that it owns (R5), with the shift added (R16).
    ``images`` are blocks of three bands.
    """
    grid = geometry.select("base", "side", "left_map", "shifted_map", "shift", F.explode(axis_tiles(F.col("out_rows"), settings.tile_rows, settings.overlap_rows)).alias("v"), axis_tiles(F.col("out_cols"), settings.tile_cols, settings.overlap_cols).alias("u"))
    grid = grid.withColumn("u", F.explode("u"))
    place = [F.col("v.at").alias("y0"), F.col("u.at").alias("x0"), F.col("v.size").alias("h"), F.col("u.size").alias("w")]
    sides = [grid.select(F.col(img).alias("img"), _name("base", "side", end).alias("out"), F.col(m).alias("matrix"), *place) for img, end, m in (("base", "left", "left_map"), ("side", "right", "shifted_map"))]
    warped = warping.warp_windows(images, sides[0].unionByName(sides[1]), cell, bands=3)
    left, right = (_as_pairs(warped.filter(F.col("out").endswith(f"\x1f{end}"))) for end in ("left", "right"))
    keys = ["base", "side", "y0", "x0"]
    both = left.withColumnRenamed("data", "left").join(right.select(*keys, F.col("data").alias("right")), keys)
    solved = estimate(both.withColumn("tile_id", F.concat_ws("\x1f", *keys)), settings.estimator, **options)
    p = F.split("tile_id", "\x1f")
    solved = solved.select(p[0].alias("base"), p[1].alias("side"), p[2].cast("int").alias("y0"), p[3].cast("int").alias("x0"), "h", "w", "disparity")
    owned = grid.select("base", "side", "shift", F.col("v.at").alias("y0"), F.col("u.at").alias("x0"), F.col("v.low").alias("top"), F.col("v.high").alias("bottom"), F.col("u.low").alias("first"), F.col("u.high").alias("end"))

    def crop(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                whole = np.frombuffer(r["disparity"], "<f4").reshape(r["h"], r["w"])
                own = whole[r["top"] - r["y0"] : r["bottom"] - r["y0"], r["first"] - r["x0"] : r["end"] - r["x0"]] + np.float32(r["shift"])
                row = {"base": r["base"], "side": r["side"], "y0": r["top"], "x0": r["first"], "h": own.shape[0], "w": own.shape[1], "data": own.astype("<f4").tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("base", pa.string()), ("side", pa.string()), *[(n, pa.int32()) for n in warping.BLOCK[:4]], ("data", pa.binary())]))

    return solved.join(owned, keys).mapInArrow(crop, f"base string, side string, {BLOCKS}")


def consistent_views(found: DataFrame, geometry: DataFrame, pairs: DataFrame, threshold: float, cell: int) -> DataFrame:
    """(base, side, y0, x0, h, w, data) of pairs: disparity and consistency in the original base image.

    ``found`` has disparities of the pairs and of the swapped ones, ``geometry`` likewise. A side's
    disparity is warped back to its original image (R2), then into the space of the pair (R1); both are
    compared strip by strip (J9, P6); disparity and mask are warped back to the base image (R2) as two
    bands of regular blocks of side ``cell``.
    """
    named = found.select(_name("base", "side").alias("img"), *warping.BLOCK)
    own = geometry.join(pairs.select("base", "side"), ["base", "side"], "left_semi")
    swapped = own.select(F.col("side").alias("base"), F.col("base").alias("side"))
    back = geometry.join(swapped, ["base", "side"], "left_semi").select(_name("base", "side").alias("img"), _name("base", "side").alias("out"), F.col("left_back").alias("matrix"), F.col("left_nrows").alias("rows"), F.col("left_ncols").alias("cols"))
    original = stage(warping.warp_windows(named, warping.tile_windows(back, cell), cell), "side-disparity")
    strips = own.select("base", "side", "right_map", F.col("out_rows"), F.col("out_cols").alias("w"), F.explode(F.sequence(F.lit(0), F.col("out_rows") - 1, F.lit(STRIP))).alias("y0"))
    strips = strips.withColumns({"x0": F.lit(0), "h": F.least(F.lit(STRIP), F.col("out_rows") - F.col("y0")).cast("int")})
    place = list(warping.BLOCK[:4])
    # out: base, side; the source of the warped side is named side, base
    into = strips.select(_name("side", "base").alias("img"), _name("base", "side").alias("out"), F.col("right_map").alias("matrix"), *place)
    other = warping.warp_windows(original.select(F.col("out").alias("img"), *warping.BLOCK), into, cell)
    first = warping.warp_windows(named, strips.select(_name("base", "side").alias("img"), _name("base", "side").alias("out"), warping.identity().alias("matrix"), *place), cell)
    met = first.join(other.select("out", "y0", F.col("data").alias("other")), ["out", "y0"])

    def compare(batches):
        import pyarrow as pa

        schema = pa.schema([("img", pa.string()), *[(n, pa.int32()) for n in place], ("data", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                a, b = (np.frombuffer(r[c], "<f4").reshape(r["h"], r["w"]) for c in ("data", "other"))
                at = np.trunc(np.arange(r["w"]) - a)
                inside = (at >= 0) & (at < r["w"])
                gathered = np.take_along_axis(b, np.where(inside, at, 0).astype(np.int64), axis=1)
                mask = inside & (np.abs(a - gathered) < threshold)
                yield pa.RecordBatch.from_pylist([{"img": r["out"], **{n: r[n] for n in place}, "data": np.stack([a, mask], axis=-1).astype("<f4").tobytes()}], schema)

    compared = stage(met.select("out", *place, "data", "other").mapInArrow(compare, f"img string, {BLOCKS}"), "compared")
    home = own.select(_name("base", "side").alias("img"), _name("base", "side").alias("out"), F.col("left_back").alias("matrix"), F.col("left_nrows").alias("rows"), F.col("left_ncols").alias("cols"))
    return _as_pairs(warping.warp_windows(compared, warping.tile_windows(home, cell), cell, bands=2))


def overlap_rings(geometry: DataFrame, buffer_px: float) -> DataFrame:
    """(base, side, ring): the common footprint of a pair in the base image, eroded by the buffer."""
    both = F.array("left_geobound", "right_geobound")
    rows = geometry.withColumn("world", rings.common_area(both, num(0.0)))
    ground = (F.col("left_z") + F.col("right_z")) / num(2) - F.col("mean_flying_height")

    def pixel(p: Column) -> Column:
        return F.array(*camera.project(Mat.of("left_camera_matrix"), Mat.of("left_rotation_matrix"), camera.centre("left_"), [p[0], p[1], ground]))

    return rows.select("base", "side", rings.eroded(F.transform("world", pixel), num(buffer_px)).alias("ring"))


def clouds(views: DataFrame, geometry: DataFrame, images: DataFrame, pairs: DataFrame, buffer_px: float) -> DataFrame:
    """(base, east, north, height, r, g, b, views) of all bases: pixels that every side's mask and eroded
    footprint hold, triangulated with each side and averaged, in the base image's colours (C6, J11).

    ``views`` is the result of :func:`consistent_views`; ``images`` has the base images in the same
    blocks. Pixels leave their blocks only where all sides agree.
    """
    sides = pairs.groupBy("base").agg(F.count(F.lit(1)).alias("n_sides"))
    met = views.join(overlap_rings(geometry, buffer_px), ["base", "side"]).join(sides, "base")
    met = met.join(images.select(F.col("img").alias("base"), "y0", "x0", F.col("data").alias("colours")), ["base", "y0", "x0"])

    def solve(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) < rows[0]["n_sides"]:
            return
        h, w, y0, x0 = (rows[0][c] for c in ("h", "w", "y0", "x0"))
        valid, found = np.ones((h, w), bool), []
        for r in rows:
            data = np.frombuffer(r["data"], "<f4").reshape(h, w, 2)
            ring = np.array(r["ring"], float).reshape(-1, 2)
            # the mask was interpolated; one means that all its neighbours agree
            valid &= (data[..., 1] >= 1 - 1e-6) & (rings.fill(ring - (x0, y0), h, w) == 1)
            found.append((r["side"], data[..., 0]))
        y, x = np.nonzero(valid)
        if not len(y):
            return
        shade = np.rint(255 * np.frombuffer(rows[0]["colours"], "<f4").reshape(h, w, 3)).astype(int)[y, x]
        for side, d in found:
            yield rows[0]["base"], side, (y + y0).tolist(), (x + x0).tolist(), d[y, x].astype(float).tolist(), shade[:, 0].tolist(), shade[:, 1].tolist(), shade[:, 2].tolist()

    lists = warping.by_group(met, ["base", "y0", "x0"], "base string, side string, y array<int>, x array<int>, d array<double>, r array<int>, g array<int>, b array<int>", solve, batch=1)
    pixels = lists.select("base", "side", F.explode(F.arrays_zip("y", "x", "d", "r", "g", "b")).alias("p")).select("base", "side", "p.*")
    needed = geometry.select("base", "side", F.col("left_camera_matrix").alias("k"), "left_map", "right_map", "left_rotation_matrix", "right_rotation_matrix", *[f"{s}_{a}" for s in ("left", "right") for a in "xyz"])
    return triangulation.triangulate(pixels.join(needed, ["base", "side"]), ["base", "y", "x", "r", "g", "b"]).drop("y", "x")


def batch_plan(spec: DataFrame, in_db: DataFrame, on_disk: DataFrame, only: str | None = None) -> DataFrame:
    """(base, side_idx, side, action) of a batch, by what is known of each base."""
    rows = catalog.chosen(catalog.expand(spec), only)
    known = catalog.state(in_db, on_disk, ["base"])
    bases = catalog.plan(rows.select("base").distinct(), known, ["base"]).select("base", "action")
    return rows.join(bases, "base")


def reconstruct(cat: Catalog, images: DataFrame, spec: DataFrame, settings: Settings, **options) -> DataFrame:
    """Points (base, X, Y, Z, r, g, b, views) of the spec's bases, less the survey's shifts.

    ``images`` are tile rows of a reader, ``spec`` has (base, sides). What is done for a base follows from
    the catalog and the cache: in both, its cloud is loaded; in neither, computed, cached and registered;
    in the cache alone, registered; in the catalog alone, deleted there and computed. Likewise for
    pairs, whose disparities are cached, and whose rectification is in the catalog. Bases without sides
    give no points. ``options`` go to the estimator.
    """
    spark = cat.spark
    place = {kind: settings.cache(kind) for kind in ("disparity", "views", "clouds")}
    rows = catalog.chosen(catalog.expand(spec), settings.base_filter).select("base", "side").distinct()
    rows = stage(rows, "spec")
    image = cat.read("image")
    ids = image.select("img_name", "img_id")
    named = rows.join(ids.withColumnsRenamed({"img_name": "base", "img_id": "base_img_id"}), "base").join(ids.withColumnsRenamed({"img_name": "side", "img_id": "side_img_id"}), "side")
    bases = rows.select("base").distinct()
    in_db = catalog.clouds_by_base(cat.read("point_cloud"), cat.read("multi_stereo"), image).select(F.col("img_name").alias("base"))
    on_disk = cached(spark, place["clouds"], ["base"], POINTS).select("base").distinct()
    plan_ = stage(catalog.plan(bases, catalog.state(in_db, on_disk, ["base"]), ["base"]), "plan")
    known = cat.read("multi_stereo").select("base_img_id")
    groups = named.groupBy("base_img_id").agg(F.sort_array(F.collect_list("side_img_id")).alias("side_img_ids")).join(known, "base_img_id", "left_anti")
    if not groups.isEmpty():
        insert_stereo(cat, stage(groups, "stereo"), settings.overlap_buffer_px)
    again = plan_.filter("action = 'recompute'").select(F.col("base").alias("img_name"))
    if not again.isEmpty():
        cat.delete_clouds(again)
    todo = stage(rows.join(plan_.filter("action in ('compute', 'recompute')").select("base"), "base"), "todo")
    if not todo.isEmpty():
        tiles = image_blocks(images)
        cell = int(images.agg(F.max(F.greatest("h", "w")).alias("n")).first()["n"])
        both = todo.unionByName(todo.select(F.col("side").alias("base"), F.col("base").alias("side"))).distinct()
        geometry = pair_geometry(cat, both, settings.shift_ratio)
        insert_pairs(cat, geometry.select("base_img_id", "side_img_id"))
        pair = ["base", "side"]
        have = cached(spark, place["disparity"], pair, BLOCKS).select(*pair).distinct()
        missing = stage(geometry.join(have, pair, "left_anti"), "missing")
        if not missing.isEmpty():
            write_raster(disparities(tiles, missing, settings, cell, **options), place["disparity"])
        have = cached(spark, place["views"], pair, BLOCKS).select(*pair).distinct()
        missing = stage(todo.join(have, pair, "left_anti"), "missing")
        if not missing.isEmpty():
            found = cached(spark, place["disparity"], pair, BLOCKS).join(both, pair, "left_semi")
            write_raster(consistent_views(found, geometry, missing, settings.threshold, cell), place["views"])
        views = cached(spark, place["views"], pair, BLOCKS).join(todo, pair, "left_semi")
        points = clouds(views, geometry.join(todo, pair, "left_semi"), tiles, todo, settings.overlap_buffer_px)
        moved = points.join(F.broadcast(cat.read("globals").select("x_shift", "y_shift").limit(1)))  # one row
        moved = moved.withColumns({"east": F.col("east") - F.col("x_shift"), "north": F.col("north") - F.col("y_shift"), "views": (F.col("views") + 1).cast("int")})
        write_clouds(moved.select("base", *[c.split()[0] for c in POINTS.split(", ")]), place["clouds"])
    points = cached(spark, place["clouds"], ["base"], POINTS).join(bases, "base", "left_semi")
    points = triangulation.as_points(points)
    new = plan_.filter("action <> 'load'").select("base")
    if not new.isEmpty():
        register_clouds(cat, points.join(new, "base", "left_semi"), new.join(ids.withColumnRenamed("img_id", "base_img_id"), F.col("base") == F.col("img_name")))
    return points
