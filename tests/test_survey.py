"""Sources, sinks, catalog, geometry and streaming end to end on a made-up survey."""

import json
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoframe.client import SurveyClient
from orthoframe.config import Settings
from orthoframe.functions import camera
from orthoframe.functions.linalg import Mat, num
from orthoframe.operators import catalog, raster, reconstruction, spatial, triangulation, warping
from orthoframe.sources import readers, writers
from orthoframe.streaming.landing import watch_specs

HEADER = "#label X0 Y0 Z0 c x0 y0 omega[deg] phi[deg] kappa[deg] a3 a4 a5 a6 rho0"


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("survey")
    lines = [HEADER] + [f"img{i}.ppm {100 + 40 * i}.0  {200 + i} {150 + i} 100.0 30 -20 {0.5 * i} -{0.3 * i} {i} 0 0 0 0 0" for i in range(4)]
    (root / "cal.xyz").write_text("\n".join(lines) + "\n\n")
    (root / "images").mkdir()
    dice = np.random.default_rng(1)
    for i in range(4):
        pixels = dice.integers(0, 256, (40, 60, 3), dtype=np.uint8)
        (root / f"images/img{i}.ppm").write_bytes(b"P6\n# made up\n60 40\n255\n" + pixels.tobytes())
    z = np.array([1000, 3000, 2000], "<i4")
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    head[96:100], head[105:107], head[107:111] = struct.pack("<I", 227), struct.pack("<H", 20), struct.pack("<I", 3)
    head[131:155], head[155:179] = struct.pack("<3d", 0.01, 0.01, 0.01), struct.pack("<3d", 1, 2, 3)
    (root / "ground.las").write_bytes(bytes(head) + b"".join(struct.pack("<iii8x", 100 * k, 200 * k, int(v)) for k, v in enumerate(z)))
    client = SurveyClient(spark, Settings(str(root), str(root / "work")))
    client.initialize(f"{root}/cal.xyz", f"{root}/images/*.ppm", f"{root}/ground.las")
    return root, client


def test_catalog_of_a_survey(spark, survey):
    root, client = survey
    assert sorted(r[0] for r in client.list_images().collect()) == [f"img{i}.ppm" for i in range(4)]
    p = client.image_params("img2.ppm").first()
    assert (p["nrows"], p["ncols"], p["x"], p["z"]) == (40, 60, 180.0, 152.0) and p["camera_matrix"][1][2] == 20.0
    assert client.global_param("mean_flying_height") == pytest.approx(151.5 - 23)
    assert client.global_param("x_shift") == 100.0 and client.global_param("epsg") == 32632
    with pytest.raises(KeyError):
        client.global_param("x_shift; DROP TABLE image")
    before = client.catalog.version("image")
    client.initialize(f"{root}/cal.xyz", f"{root}/images/*.ppm", f"{root}/ground.las")  # nothing to do
    assert client.catalog.version("image") == before
    assert client.image_params("none").count() == 0


def rotation(o, p, k):
    o, p, k = np.radians([o, p, k])
    x = np.array([[1, 0, 0], [0, np.cos(o), -np.sin(o)], [0, np.sin(o), np.cos(o)]])
    y = np.array([[np.cos(p), 0, np.sin(p)], [0, 1, 0], [-np.sin(p), 0, np.cos(p)]])
    z = np.array([[np.cos(k), -np.sin(k), 0], [np.sin(k), np.cos(k), 0], [0, 0, 1]])
    return np.diag([1, -1, -1]) @ (x @ y @ z).T


def test_footprints_project_back(survey):
    _, client = survey
    height = client.global_param("mean_flying_height")
    for p in client.catalog.read("image_param").collect():
        i = p["img_param_id"] - 1
        r = np.array(p["rotation_matrix"])
        assert np.allclose(r, rotation(0.5 * i, -0.3 * i, i))
        k = np.array(p["camera_matrix"])
        corners = [k @ r @ (np.array(c) - [p["x"], p["y"], p["z"]]) for c in p["geobound"]]
        assert np.allclose([c[:2] / c[2] for c in corners], [(0, 0), (60, 0), (60, 40), (0, 40)])
        assert np.allclose([c[2] for c in corners], height)


def _pairs(client):
    cams = client.catalog.read("image_param").withColumnRenamed("img_param_id", "img_id")
    left = cams.select(*[F.col(c).alias(f"left_{c}") for c in cams.columns])
    right = cams.select(*[F.col(c).alias(f"right_{c}") for c in cams.columns])
    return left.join(right, F.col("left_img_id") + 1 == F.col("right_img_id"))


def test_rectified_points_share_rows_and_triangulate_back(spark, survey):
    _, client = survey
    p = camera.rectify_pairs(_pairs(client)).withColumn("shift", camera.disparity_shift(num(128.5)))
    rows, world = [], {}
    for q in p.collect():
        h1, h2, hs = (np.array(q[c]) for c in ("H1", "H2", "H_shift"))
        assert np.allclose(np.array(q["R"]) @ np.array(q["R"]).T, np.eye(3))
        assert np.allclose(np.array(q["I1"]) @ h1, np.eye(3))
        k = np.array(q["left_camera_matrix"])
        for point in ((120.0, 205.0, 25.0), (170.0, 190.0, 40.0)):
            pixel = []
            for side in ("left", "right"):
                v = k @ np.array(q[f"{side}_rotation_matrix"]) @ (np.array(point) - [q[f"{side}_{a}"] for a in "xyz"])
                pixel.append(v / v[2])
            a, b = (np.linalg.inv(h @ hs) @ v for h, v in ((h1, pixel[0]), (h2, pixel[1])))
            a, b = a / a[2], b / b[2]
            assert a[1] == pytest.approx(b[1], abs=1e-6)
            key = (q["left_img_id"], len(rows))
            world[key] = point
            rows.append((*key, float(pixel[0][0]), float(pixel[0][1]), float(a[0] - b[0]), q["left_img_id"]))
        # a point below the left principal point at the flying height has the disparity of the shift
        assert isinstance(q["shift"], int)
    shift = Mat.of("H_shift")
    views = p.withColumns({"left_map": (Mat.of("H1") @ shift).column(), "right_map": (Mat.of("H2") @ shift).column()}).withColumn("k", F.col("left_camera_matrix"))
    frame = spark.createDataFrame(rows, "base int, n int, x double, y double, d double, left_img_id int").join(views.drop("base"), "left_img_id")
    for r in triangulation.triangulate(frame, ["base", "n"]).collect():
        assert (r["east"], r["north"], r["height"]) == pytest.approx(world[r["base"], r["n"]], abs=1e-5)


def test_pairs_and_stereo_rows(spark, survey):
    _, client = survey
    cat = client.catalog
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 1)], "base_img_id int, side_img_id int")
    for _ in range(2):  # the second time there is nothing to add
        reconstruction.insert_pairs(cat, pairs)
    found = cat.read("image_pair").collect()
    assert sorted((r["base_img_id"], r["side_img_id"]) for r in found) == [(1, 2), (2, 1), (2, 3)]
    assert len({r["rect_param_id"] for r in found}) == 3 and all(0 < r["overlap"] < 1 for r in found)
    named = catalog.named_pairs(cat.read("image_pair"), cat.read("image")).filter("base_name = 'img0.ppm' and side_name = 'img1.ppm'")
    one = catalog.rectification(named, cat.read("rectification_param")).first()
    r = np.array(one["r"])
    assert np.allclose(r @ r.T, np.eye(3))
    spec = spark.createDataFrame([(1, [2]), (1, [4]), (3, [2, 4])], "base_img_id int, side_img_ids array<int>").filter("base_img_id = 3 or side_img_ids[0] = 2")
    reconstruction.insert_stereo(cat, spec, buffer_px=2.0)
    from orthoframe.functions import rings

    feet = {p["img_param_id"]: np.array(p["geobound"])[:, :2] for p in cat.read("image_param").collect()}
    gsd = client.global_param("estimated_gsd")
    for base, sides in ((1, [2]), (3, [2, 4])):
        ring = feet[base]
        for s in sides:
            ring = rings.clip(ring, feet[s])
        ring = rings.erode(ring, 2 * gsd)
        row = cat.read("multi_stereo").filter(f"base_img_id = {base}").first()
        assert row["overlapping_bounds"] == [i for i in feet if len(ring) and rings.intersects(ring, feet[i])]


def test_rectified_images(spark, survey):
    root, client = survey
    p = camera.rectify_pairs(_pairs(client).filter("left_img_id = 1")).withColumns({"shift": F.lit(3), "left_name": F.lit("a"), "right_name": F.lit("b")})
    maps = reconstruction.rectifying_maps(p, "left_name", "right_name")
    dice = np.random.default_rng(2)
    image = dice.random((40, 60)).astype("<f4")
    tiles = spark.createDataFrame(warping.to_tiles("a", image, 16) + warping.to_tiles("b", image, 16), warping.TILES)
    rows = warping.warp_tiles(tiles, maps, 16).collect()
    q = p.first()
    from orthoframe.functions.kernels import warp

    for side, h, move in (("left", "H1", 0), ("right", "H2", 3)):
        got = warping.from_tiles([r for r in rows if r["out"].endswith(side)], 16)
        matrix = np.array(q[h]) @ np.array(q["H_shift"]) @ np.array([[1, 0, -move], [0, 1, 0], [0, 0, 1]])
        assert np.allclose(got, warp(image, matrix, q["out_rows"], q["out_cols"]), atol=1e-5) and got.any()


def test_clouds_are_registered_replaced_and_deleted(spark, survey):
    root, client = survey
    cat = client.catalog
    cat.write("multi_stereo", spark.createDataFrame([(1, 1, [1, 2], False, None), (2, 2, [1, 2, 3], False, None)], "ms_id int, base_img_id int, overlapping_bounds array<int>, pc_ready boolean, pc_id int"))
    points = spark.createDataFrame([("b1", 0.0, 1.0, 5.0, 1, 2, 3), ("b1", 2.0, -1.0, 6.0, 4, 5, 6), ("b2", 9.0, 9.0, 9.0, 7, 8, 9)], "base string, X double, Y double, Z double, r int, g int, b int")
    names = spark.createDataFrame([("b1", "img0.ppm", 1), ("b2", "img1.ppm", 2)], "base string, img_name string, base_img_id int")
    for _ in range(2):
        reconstruction.register_clouds(cat, points, names)
    assert cat.read("point_cloud").count() == 2
    stereo = {r["base_img_id"]: r for r in cat.read("multi_stereo").collect()}
    clouds = {r["pc_id"]: r for r in cat.read("point_cloud").collect()}
    assert all(s["pc_ready"] for s in stereo.values())
    one = clouds[stereo[1]["pc_id"]]
    assert one["pc_name"] == "img0" and one["n_points"] == 2 and one["footprint"] == [[0.0, -1.0], [0.0, 1.0], [2.0, 1.0], [2.0, -1.0]]
    client.delete_point_cloud("img0.ppm")
    client.delete_point_cloud("img3.ppm")
    after = {r["base_img_id"]: r for r in cat.read("multi_stereo").collect()}
    assert not after[1]["pc_ready"] and after[1]["pc_id"] is None and after[2] == stereo[2]
    assert [r["pc_name"] for r in cat.read("point_cloud").collect()] == ["img1"]


def test_clouds_as_text(spark, tmp_path):
    points = spark.createDataFrame([(1.5, -2.25, 3.125, 1, 2, 255), (4.0, 5.0, 6.1, 7, 8, 9)], "X double, Y double, Z double, r int, g int, b int")
    assert writers.write_ply(points, f"{tmp_path}/a", views=3) == 2
    lines = {r["value"] for r in spark.read.text(f"{tmp_path}/a/vertices").collect()}
    assert lines == {"1.500000 -2.250000 3.125000 1 2 255 3", "4.000000 5.000000 6.100000 7 8 9 3"}
    head = [r["value"] for r in spark.read.text(f"{tmp_path}/a/header").collect()]
    assert head[2] == "element vertex 2" and head[-1] == "end_header" and "property uchar views" in head
    got = {tuple(r) for r in readers.read_ply(spark, f"{tmp_path}/a/*").collect()}
    assert got == {(1.5, -2.25, 3.125), (4.0, 5.0, float(np.float32(6.1)))}
    writers.write_ply(points, f"{tmp_path}/b")
    assert writers.append_ply(points, f"{tmp_path}/b", 2) == 4
    assert readers.read_ply(spark, f"{tmp_path}/b/*").count() == 4
    assert spark.read.text(f"{tmp_path}/b/header").filter("value = 'element vertex 4'").count() == 1


def test_images_as_tiles(spark, survey):
    root, _ = survey
    tiles = readers.read_images(spark, f"{root}/images/img1.ppm", 32).collect()
    assert sorted((t["ty"], t["tx"], t["h"], t["w"]) for t in tiles) == [(0, 0, 32, 32), (0, 1, 32, 28), (1, 0, 8, 32), (1, 1, 8, 28)]
    raw = np.frombuffer((root / "images/img1.ppm").read_bytes()[-7200:], np.uint8).reshape(40, 60, 3)
    last = next(t for t in tiles if t["ty"] == t["tx"] == 1)
    assert np.allclose(np.array(last["data"]).reshape(8, 28, 3), raw[32:, 32:] / 255, atol=1e-7)


def test_tiled_warp_equals_a_whole_one(spark):
    from orthoframe.functions.kernels import warp

    dice = np.random.default_rng(6)
    image = dice.random((50, 70)).astype("<f4")
    m = [[0.9, 0.15, 4.0], [-0.1, 1.05, 3.0], [0.0005, 0.0002, 1.0]]
    tiles = spark.createDataFrame(warping.to_tiles("a", image, 16), warping.TILES)
    maps = spark.createDataFrame([("a", "o", m, 60, 65), ("a", "far", [[1.0, 0.0, 500.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 5, 40)], "img string, out string, matrix array<array<double>>, rows int, cols int")
    rows = warping.warp_tiles(tiles, maps, 16).collect()
    whole = warping.from_tiles([r for r in rows if r["out"] == "o"], 16)
    assert np.allclose(whole, warp(image, m, 60, 65), atol=1e-5)
    far = warping.from_tiles([r for r in rows if r["out"] == "far"], 16)
    assert far.shape == (5, 40) and not far.any()


@pytest.mark.parametrize(("n", "t", "o"), [(8, 4, 2), (9, 4, 1), (5, 8, 2), (4, 4, 2), (4480, 2880, 1280), (11, 5, 3)])
def test_tiles_cover_and_own_every_pixel(spark, n, t, o):
    starts = raster.tile_starts(n, t, o)
    t_ = min(n, t)
    assert starts[0] == 0 and max(starts) + t_ == n
    owned = np.zeros(n, int)
    low, high = raster.kept_range(F.col("s"), n, t, o)
    for r in spark.createDataFrame([(s,) for s in dict.fromkeys(starts)], "s int").select("s", low.alias("l"), high.alias("h")).collect():
        owned[r["l"] : r["h"]] += 1
        assert r["s"] <= r["l"] < r["h"] <= r["s"] + t_
    assert owned.all()


def test_spatial_join_equals_all_pairs(spark):
    dice = np.random.default_rng(8)
    corner = dice.uniform(-200, 200, (80, 2))
    size = dice.uniform(1, 90, (80, 2))
    box = [(i, *map(float, (*c, *(c + s)))) for i, (c, s) in enumerate(zip(corner, size, strict=True))]
    a = spark.createDataFrame(box[:40], "a int, ax0 double, ay0 double, ax1 double, ay1 double")
    b = spark.createDataFrame(box[40:], "b int, bx0 double, by0 double, bx1 double, by1 double")
    from orthoframe.functions.rings import box_touches

    test = box_touches([F.col(f"a{n}") for n in ("x0", "y0", "x1", "y1")], [F.col(f"b{n}") for n in ("x0", "y0", "x1", "y1")])
    got = spatial.spatial_join(a, b, ["ax0", "ay0", "ax1", "ay1"], ["bx0", "by0", "bx1", "by1"], 37.0, test).select("a", "b").collect()
    want = {(p[0], q[0]) for p in box[:40] for q in box[40:] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_specs_as_a_batch_and_a_stream(spark, survey, tmp_path):
    _, client = survey
    (tmp_path / "in").mkdir()
    spec = [{"base": "img0.ppm", "sides": ["img1.ppm", "img2.ppm"]}, {"base": "img3.ppm", "sides": ["img2.ppm"]}, {"base": "img1.ppm", "sides": []}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, spec)))
    known = spark.createDataFrame([("img0.ppm",)], "base string")
    rows = {(r["base"], r["side"]): r["action"] for r in client.plan(f"{tmp_path}/in", known, known.limit(0)).collect()}
    assert rows == {("img0.ppm", "img1.ppm"): "recompute", ("img0.ppm", "img2.ppm"): "recompute", ("img3.ppm", "img2.ppm"): "compute"}
    seen = []
    for _ in range(2):  # the second run finds nothing new
        watch_specs(spark, f"{tmp_path}/in", f"{tmp_path}/check", lambda df, n: seen.extend((r["base"], r["side_idx"], r["side"]) for r in df.collect())).awaitTermination()
    assert sorted(seen) == [("img0.ppm", 0, "img1.ppm"), ("img0.ppm", 1, "img2.ppm"), ("img3.ppm", 0, "img2.ppm")]


def test_odd_names_and_states(spark):
    names = spark.createDataFrame([("a.b.jpeg",), ("plain",), (".hidden",)], "n string").select(catalog.stem(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in names] == ["a.b", "plain", ".hidden"]
    assert catalog.has_database(spark, "DEFAULT") and not catalog.has_database(spark, "nowhere")
    with pytest.raises(ValueError, match="CNN or SGM"):
        Settings("a", "b", estimator="other")


def ground_colour(x, y):
    """A texture without repeats, from 0 to 1, at world places."""
    a = np.sin(0.9 * x + 0.4 * y) + np.sin(0.53 * y - 0.31 * x + 1) + np.sin(0.21 * x * y / 10)
    return np.stack([(a + 3) / 6, (np.sin(0.7 * y) + 1) / 2, (np.cos(0.45 * x) + 1) / 2], axis=-1)


@pytest.fixture(scope="module")
def flight(spark, tmp_path_factory):
    """Three cameras in a row over flat ground at a height of 20, looking down."""
    root = tmp_path_factory.mktemp("flight")
    (root / "images").mkdir()
    rows, cols, c, ground = 72, 96, 100.0, 20.0
    lines = [HEADER]
    for i in range(3):
        cx, cy, cz = 500.0 + 8 * i, 700.0, 120.0
        lines.append(f"cam{i}.ppm {cx} {cy} {cz} {c} {cols / 2} {-rows / 2} 0 0 0 0 0 0 0 0")
        v, u = np.mgrid[0:rows, 0:cols].astype(float)
        x, y = cx + (u - cols / 2) * (cz - ground) / c, cy - (v - rows / 2) * (cz - ground) / c
        pixels = np.rint(255 * ground_colour(x, y)).astype(np.uint8)
        (root / f"images/cam{i}.ppm").write_bytes(f"P6\n{cols} {rows}\n255\n".encode() + pixels.tobytes())
    (root / "cal.xyz").write_text("\n".join(lines) + "\n")
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes([1, 2])
    head[96:100], head[105:107], head[107:111] = struct.pack("<I", 227), struct.pack("<H", 20), struct.pack("<I", 1)
    head[131:155], head[155:179] = struct.pack("<3d", 1, 1, 1), struct.pack("<3d", 0, 0, 0)
    (root / "ground.las").write_bytes(bytes(head) + struct.pack("<iii8x", 0, 0, 20))
    (root / "spec.json").write_text("\n".join(json.dumps(r) for r in ({"base": "cam1.ppm", "sides": ["cam0.ppm", "cam2.ppm"]}, {"base": "cam0.ppm", "sides": ["cam1.ppm"]}, {"base": "cam2.ppm", "sides": []})))
    settings = Settings(str(root), str(root / "work"), estimator="SGM", overlap_buffer_px=3.0, tile_rows=40, tile_cols=60, overlap_rows=12, overlap_cols=24)
    client = SurveyClient(spark, settings)
    client.initialize(f"{root}/cal.xyz", f"{root}/images/*.ppm", f"{root}/ground.las")
    return root, client


def test_reconstruction_from_images_to_clouds(spark, flight, monkeypatch):
    """All four cases of bases and pairs, and a second run that computes nothing."""
    root, client = flight
    calls = []
    for name in ("disparities", "consistent_views", "clouds"):
        own = getattr(reconstruction, name)
        monkeypatch.setattr(reconstruction, name, lambda *a, own=own, name=name, **o: calls.append(name) or own(*a, **o))

    def run():
        calls.clear()
        points = client.reconstruct(f"{root}/images", f"{root}/spec.json", size=32, factor=1, low=-6, high=6)
        return sorted(map(tuple, points.select("base", *[F.round(c, 6) for c in "XYZ"], "r", "g", "b", "views").collect())), list(calls)

    first, did = run()
    assert did == ["disparities", "consistent_views", "clouds"]
    count = {b: sum(r[0] == b for r in first) for b in ("cam0.ppm", "cam1.ppm", "cam2.ppm")}
    assert count["cam0.ppm"] > 1500 and count["cam1.ppm"] > 1500 and count["cam2.ppm"] == 0
    got = np.array([r[1:4] for r in first])
    assert abs(np.median(got[:, 2]) - 20) < 0.5 and np.mean(np.abs(got[:, 2] - 20) < 3) > 0.95
    assert {(r[0], r[7]) for r in first} == {("cam0.ppm", 2), ("cam1.ppm", 3)}
    # colours are those of the ground where the points lie
    near = np.abs(got[:, 2] - 20) < 0.5
    want = 255 * ground_colour(got[near, 0] + client.global_param("x_shift"), got[near, 1] + client.global_param("y_shift"))
    assert np.abs(want - np.array([r[4:7] for r in first])[near]).mean() < 8
    # the eroded footprint keeps the points off the borders of what both images see
    edges = {"cam0.ppm": (508 - 48, 500 + 48), "cam1.ppm": (516 - 48, 500 + 48)}
    for base, (low, high) in edges.items():
        x = np.array([r[1] for r in first if r[0] == base]) + client.global_param("x_shift")
        assert x.min() > low + 1.5 and x.max() < high - 1.5
    clouds = {r["pc_name"]: r["n_points"] for r in client.catalog.read("point_cloud").collect()}
    assert clouds == {"cam0": count["cam0.ppm"], "cam1": count["cam1.ppm"]}
    assert client.catalog.read("image_pair").count() == 4

    assert run() == (first, [])  # in the catalog and in the cache: loaded
    client.delete_point_cloud("cam1.ppm")  # in the cache alone: registered again
    assert run() == (first, []) and client.catalog.read("point_cloud").count() == 2
    shutil.rmtree(root / "work/clouds/base=cam0.ppm")  # in the catalog alone: computed from cached views
    assert run() == (first, ["clouds"]) and client.catalog.read("point_cloud").count() == 2
    shutil.rmtree(root / "work/clouds/base=cam0.ppm")
    shutil.rmtree(root / "work/views/base=cam0.ppm")
    shutil.rmtree(root / "work/disparity/base=cam0.ppm")  # a pair in the catalog alone: its disparity is computed
    assert run() == (first, ["disparities", "consistent_views", "clouds"])
    client.catalog.write("image_pair", client.catalog.read("image_pair").limit(0))  # pairs in the cache alone
    shutil.rmtree(root / "work/clouds/base=cam0.ppm")
    assert run() == (first, ["clouds"]) and client.catalog.read("image_pair").count() == 2

    points = client.run_multiview(f"{root}/images", "cam1.ppm", ["cam0.ppm", "cam2.ppm"])
    assert client.export_cloud(points, "cam1.ppm", f"{root}/cam1.ply") == count["cam1.ppm"]
    lines = (root / "cam1.ply").read_text().splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", f"element vertex {count['cam1.ppm']}"] and lines[-1].endswith(" 3")
    assert readers.read_ply(spark, f"{root}/cam1.ply").count() == count["cam1.ppm"]


def test_a_crash_between_part_and_snapshot_loses_nothing(spark, tmp_path):
    cat = catalog.Catalog(spark, f"{tmp_path}/cat")
    cat.create()
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "img_name string, img_param_id int")
    assert [r["img_id"] for r in cat.append("image", rows, "img_id", ["img_name"]).orderBy("img_name").collect()] == [1, 2]
    cat._part("image", cat.read("image"))  # a writer that stops before its snapshot
    (tmp_path / "cat/image/snapshots/_draft").write_text("half")
    cat.create()  # nothing to do
    assert sorted(r["img_name"] for r in cat.read("image").collect()) == ["a", "b"]
    cat.append("image", rows.limit(1), "img_id", ["img_name"])
    assert sorted(r["img_id"] for r in cat.read("image").collect()) == [1, 2, 3]
    many = spark.range(1000).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("img_name"), F.lit(1).alias("img_param_id")).repartition(7)
    added = cat.append("image", many, "img_id", ["img_name"]).collect()
    assert sorted((r["img_name"], r["img_id"]) for r in added) == [(f"n{i:04d}", 4 + i) for i in range(1000)]


def test_a_second_raster_leaves_the_first(spark, tmp_path):
    schema = f"base string, side string, {reconstruction.BLOCKS}"
    for base, n in (("a", 1), ("b", 2), ("a", 3)):
        writers.write_raster(spark.createDataFrame([(base, "s", 0, 0, 1, 1, bytes([n] * 4))], schema), f"{tmp_path}/r")
    got = writers.cached(spark, f"{tmp_path}/r", ["base", "side"], reconstruction.BLOCKS).collect()
    assert sorted((r["base"], r["side"], bytes(r["data"])) for r in got) == [("a", "s", bytes([3] * 4)), ("b", "s", bytes([2] * 4))]
    assert writers.cached(spark, f"{tmp_path}/none", ["base"], "d int").count() == 0


def test_faces_of_a_cloud_are_no_vertices(spark, tmp_path):
    head = "ply\nformat ascii 1.0\ncomment 3 0 1\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "0 0 1\n1 0 nan\n0 1 3\n3 0 1 2\n3 2 1 0\n")
    got = sorted((r["x"], r["y"], str(r["z"])) for r in readers.read_ply(spark, f"{tmp_path}/a.ply").collect())
    assert got == [(0.0, 0.0, "1.0"), (0.0, 1.0, "3.0"), (1.0, 0.0, "nan")]


def test_jpeg_and_png_pixels(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(20, 12, 1)
    for y in range(12):
        for x in range(20):
            image.setRGB(x, y, (10 * x << 16) | (20 * y << 8) | 77)
    for kind in ("png", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(f"{tmp_path}/im.{kind}"))
    tiles = readers.read_images(spark, str(tmp_path), 16).collect()
    assert sorted((t["img"], t["ty"], t["tx"], t["h"], t["w"], t["bands"]) for t in tiles) == [(f"im.{k}", 0, j, 12, w, 3) for k in ("jpg", "png") for j, w in ((0, 16), (1, 4))]
    for t in tiles:
        data = np.rint(255 * np.array(t["data"]).reshape(t["h"], t["w"], 3))
        y, x = np.mgrid[0 : t["h"], t["x0"] : t["x0"] + t["w"]]
        off = np.abs(data - np.stack([10 * x, 20 * y, np.full_like(x, 77)], axis=-1)).max()
        assert off == 0 if t["img"] == "im.png" else off < 60


def test_pixels_meet_only_tiles_that_cover_them(spark):
    for n, t, o in ((8, 4, 2), (9, 4, 1), (11, 5, 3), (4, 4, 0), (3, 8, 2), (23, 6, 5)):
        grid = raster.tile_grid(spark, n, n, t, t, o, o)
        pixels = spark.range(n * n).select((F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
        cut = raster.cut_tiles(pixels, grid, t, t)
        assert "NestedLoop" not in cut._jdf.queryExecution().toString()
        want = {(g["tile"], y, x) for g in grid.collect() for y in range(g["y0"], min(n, g["y0"] + t)) for x in range(g["x0"], min(n, g["x0"] + t))}
        got = [(r["tile"], r["y"], r["x"]) for r in cut.collect()]
        assert len(got) == len(want) and set(got) == want
