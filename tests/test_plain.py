"""Queries that SQL can't express, against plain Python or NumPy over the same rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoframe.functions import rings
from orthoframe.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: np.array(r["embedding"], np.float32) for r in rows}


def bilinear(image, x, y):
    """One value, places outside as zero."""
    rows, cols = image.shape
    x0, y0 = int(np.floor(x)), int(np.floor(y))
    total = 0.0
    for yy, wy in ((y0, 1 - (y - y0)), (y0 + 1, y - y0)):
        for xx, wx in ((x0, 1 - (x - x0)), (x0 + 1, x - x0)):
            if 0 <= yy < rows and 0 <= xx < cols:
                total += float(image[yy, xx]) * wy * wx
    return total


def test_warp(spark, vectors):
    from orthoframe.operators import warping

    some = dict(list(vectors.items())[:25])
    m = np.array([(1.0, 0.1, 0.5), (-0.1, 1.0, 0.25), (0.001, 0.0, 1.0)])
    tiles = spark.createDataFrame([t for k, v in some.items() for t in warping.to_tiles(str(k), v.reshape(8, 8), 8)], warping.TILES)
    maps = tiles.select("img", F.col("img").alias("out"), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m]).alias("matrix"), F.lit(10).alias("rows"), F.lit(9).alias("cols"))
    rows = warping.warp_tiles(tiles, maps, 8).collect()
    for k, v in some.items():
        whole = warping.from_tiles([r for r in rows if r["out"] == str(k)], 8)
        for y in range(10):
            for x in range(9):
                u, w_, s = m @ (x, y, 1)
                assert whole[y, x] == pytest.approx(bilinear(v.reshape(8, 8), u / s, w_ / s), abs=1e-5)


def plain_clean(valid):
    """Specks, holes and closing of a validity mask, pixel by pixel."""
    def without_small(mask, least):
        out, seen = mask.copy(), set()
        for start in zip(*np.nonzero(mask), strict=True):
            if start in seen:
                continue
            group, todo = {start}, [start]
            while todo:
                y, x = todo.pop()
                for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in group:
                        group.add(p)
                        todo.append(p)
            seen |= group
            if len(group) < least:
                for p in group:
                    out[p] = False
        return out

    near = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9]

    def reach(mask, outside):
        h, w = mask.shape
        at = lambda y, x: mask[y, x] if 0 <= y < h and 0 <= x < w else outside
        return np.array([[[at(y + a, x + b) for a, b in near] for x in range(w)] for y in range(h)])

    bad = ~without_small(~without_small(~valid, 20), 10)
    return ~reach(reach(bad, False).any(axis=2), True).all(axis=2)


def test_clean_mask(spark, vectors):
    got = {k: set() for k in vectors}
    for r in queries.q_clean_mask(spark, SF).collect():
        got[r["vec_id"]].add(r["pos"])
    for k, v in list(vectors.items())[:150]:
        want = plain_clean(np.abs(v.reshape(8, 8).astype(float)) < 0.4)
        assert got[k] == set(np.flatnonzero(want.ravel()).tolist())


def plain_semi_global(left, right, low, high, p1=3.0, p2=24.0):
    """Census, four paths and a parabola, with loops over pixels and disparities."""
    h, w = left.shape
    n = high - low + 1

    def bits(image, y, x):
        clip = lambda v, most: min(max(v, 0), most - 1)
        return [image[clip(y + a, h), clip(x + b, w)] < image[y, x] for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]

    cost = np.full((h, w, n), 25.0)
    for y in range(h):
        for x in range(w):
            for k in range(n):
                if 0 <= x - low - k < w:
                    cost[y, x, k] = sum(p != q for p, q in zip(bits(left, y, x), bits(right, y, x - low - k), strict=True))
    total = np.zeros_like(cost)
    for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        path = np.zeros_like(cost)
        for y in range(h)[:: dy or 1]:
            for x in range(w)[:: dx or 1]:
                py, px = y - dy, x - dx
                if not (0 <= py < h and 0 <= px < w):
                    path[y, x] = cost[y, x]
                    continue
                last = path[py, px]
                for k in range(n):
                    step = [last[k], last.min() + p2] + [last[j] + p1 for j in (k - 1, k + 1) if 0 <= j < n]
                    path[y, x, k] = cost[y, x, k] + min(step) - last.min()
        total += path
    out = np.full((h, w), np.nan)
    for y in range(h):
        for x in range(w):
            t = total[y, x]
            k = int(t.argmin())
            d = float(k)
            if 0 < k < n - 1 and t[k - 1] - 2 * t[k] + t[k + 1] > 0:
                d += (t[k - 1] - t[k + 1]) / (2 * (t[k - 1] - 2 * t[k] + t[k + 1]))
            if 0 <= x - np.rint(d + low) < w:
                out[y, x] = d + low
    return out


def test_semi_global(spark, vectors):
    got = {r["tile_id"]: r for r in queries.q_semi_global(spark, SF).collect()}
    assert len(got) == len(vectors)
    for k, v in list(vectors.items())[:12]:
        pictures = []
        for shift in (0, 1):
            small = np.roll(np.abs(v.reshape(8, 8)), -shift, axis=1).clip(0, 1)
            eight = np.rint(255 * small.astype("<f4").astype(float)).astype(int)
            pictures.append((((19595 + 38470 + 7471) * eight + 32768) >> 16).astype(float))
        d = plain_semi_global(*pictures, 0, 3)
        wide = lambda a: np.kron(a, np.ones((6, 6)))
        disparity, mask = wide(np.where(np.isnan(d), -32, d) * 6), wide((~np.isnan(d)).astype(float))
        assert got[k]["mask"] == zlib.crc32(mask.astype("<f4").tobytes())
        assert got[k]["disparity"] == zlib.crc32(disparity.astype("<f4").tobytes())


def test_multiview_cloud(spark):
    """Every pixel of some bases by hand: masks, footprints in the image, and the two rays' midpoint."""
    views, geometry, images, pairs = queries.multiview_inputs(spark, SF)
    views, images = views.collect(), {r["img"]: r for r in images.collect()}
    geo = {(r["base"], r["side"]): r for r in geometry.collect()}
    sides = {}
    for b, s in geo:
        sides.setdefault(b, []).append(s)
    block = {(r["base"], r["side"]): r for r in views}
    got = {}
    for r in queries.q_multiview_cloud(spark, SF).collect():
        got.setdefault(r["base"], []).append(r)
    assert got and max(map(len, sides.values())) == 2
    for base, near in sides.items():
        if (base, near[0]) not in block:
            continue
        first = block[base, near[0]]
        want = []
        data = {s: np.frombuffer(block[base, s]["data"], "<f4").reshape(8, 8, 2) for s in near}
        colour = np.frombuffer(images[base]["data"], "<f4").reshape(8, 8, 3)
        areas = {}
        for s in near:
            g = geo[base, s]
            k, rot, at = np.array(g["left_camera_matrix"]), np.array(g["left_rotation_matrix"]), np.array([g[f"left_{a}"] for a in "xyz"])
            world = rings.clip(np.array(g["left_geobound"])[:, :2], np.array(g["right_geobound"])[:, :2])
            ground = (g["left_z"] + g["right_z"]) / 2 - g["mean_flying_height"]
            seen = [k @ rot @ (np.array([*p, ground]) - at) for p in world]
            areas[s] = rings.oriented(rings.erode(np.array([p[:2] / p[2] for p in seen]), 5.0))
        for y in range(8):
            for x in range(8):
                px, py = x + first["x0"], y + first["y0"]
                ok = all(data[s][y, x, 1] == 1 for s in near)
                for s in near:
                    ring = areas[s]
                    ok &= len(ring) > 2 and all((q[0] - p[0]) * (py + 0.5 - p[1]) - (q[1] - p[1]) * (px + 0.5 - p[0]) > 0 for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True))
                if not ok:
                    continue
                points = []
                for s in near:
                    g = geo[base, s]
                    k = np.array(g["left_camera_matrix"])
                    v = np.linalg.inv(np.array(g["left_map"])) @ (px, py, 1)
                    v = np.array(g["right_map"]) @ (v[0] / v[2] - float(data[s][y, x, 0]), v[1] / v[2], 1)
                    a, b = (np.array([g[f"{e}_{c}"] for c in "xyz"]) for e in ("left", "right"))
                    r_ = np.array(g["left_rotation_matrix"]).T @ (px - k[0, 2], py - k[1, 2], k[0, 0])
                    s_ = np.array(g["right_rotation_matrix"]).T @ (v[0] / v[2] - k[0, 2], v[1] / v[2] - k[1, 2], k[0, 0])
                    t = np.linalg.lstsq(np.stack([r_, -s_], axis=1), b - a, rcond=None)[0]
                    points.append((a + t[0] * r_ + b + t[1] * s_) / 2)
                want.append((*np.mean(points, axis=0), *np.rint(255 * colour[y, x]).astype(int).tolist()))
        order = lambda p: (*p[3:], p[0])
        mine = sorted(((r["east"], r["north"], r["height"], r["r"], r["g"], r["b"]) for r in got.get(base, [])), key=order)
        assert len(mine) == len(want)
        if want:
            assert np.allclose(np.array(mine), np.array(sorted(want, key=order)), atol=2e-3)
            assert all(r["views"] == len(near) for r in got[base])
