"""Resampling, perspective, warps, contrast and the sphere, by invariants and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry
from gridloom.operators import contrast, tiles, warps


def test_homography_of_identity_shift_and_corners():
    corners = warps.corner_points(8, 8)
    assert np.allclose(warps.homography(corners, corners), np.eye(3))
    assert np.allclose(warps.homography(corners, corners + [2, -1]), [[1, 0, 2], [0, 1, -1], [0, 0, 1]])
    source = np.array([(0.5, 0.25), (6.5, 0), (7, 6.75), (0.25, 7)])
    y, x = warps.perspective_places(8, 8, warps.homography(corners, source))
    for (cx, cy), (u, v) in zip(corners.astype(int), source, strict=True):
        assert np.isclose(x[cy, cx], u) and np.isclose(y[cy, cx], v)


def test_tiles_by_identity_shift_and_labels(spark):
    random = np.random.default_rng(0)
    rows = [(k, random.random(64).tolist()) for k in range(5)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, t array<double>")
    same, moved = warps.corner_points(8, 8), warps.corner_points(8, 8) + [1, 2]
    out = df.select("k", "t", warps.perspective(F.col("t"), 8, 8, same).alias("same"), warps.perspective(F.col("t"), 8, 8, moved, fill=-1.0).alias("moved"), warps.perspective(F.transform("t", lambda v: (v > 0.5).cast("double")), 8, 8, moved, label=True).alias("mask")).collect()
    for r in out:
        if r["t"] is None:
            assert r["same"] is r["moved"] is None
            continue
        a = np.array(r["t"]).reshape(8, 8)
        assert np.allclose(r["same"], r["t"])
        want = np.full((8, 8), -1.0)
        want[:6, :7] = a[2:, 1:]
        assert np.allclose(np.array(r["moved"]).reshape(8, 8), want)
        mask = np.zeros((8, 8))
        mask[:6, :7] = a[2:, 1:] > 0.5
        assert np.array_equal(np.array(r["mask"]).reshape(8, 8), mask)


def test_expressions_equal_kernels(spark):
    random = np.random.default_rng(1)
    a = random.random((8, 8))
    row = spark.createDataFrame([(a.ravel().tolist(),)], "t array<double>").select(
        warps.sampled(F.col("t"), warps.resize_sources(8, 8, 5, 11)).alias("resized"), warps.sampled(F.col("t"), warps.rotation_sources(8, 8, 30)).alias("turned"), warps.jitter(F.col("t"), 1.2, 0.8).alias("jittered")
    ).first()
    assert np.allclose(np.array(row["resized"]).reshape(5, 11), tiles.bilinear(a, 5, 11))
    assert np.allclose(np.array(row["turned"]).reshape(8, 8), tiles.rotate(a, 30))
    assert np.allclose(np.array(row["jittered"]).reshape(8, 8), tiles.jitter(a, 1.2, 0.8))


def test_random_perspective_is_repeatable_and_keeps_labels_binary(spark):
    df = spark.createDataFrame([(k, [float(i % 8 > 3) for i in range(64)]) for k in range(20)] + [(77, None)], "k long, t array<double>")
    one, two = ({r["k"]: r["tile"] for r in warps.random_perspective(df, "k", "t", 8, 8, 3, share=0.45, label=True).repartition(n).collect()} for n in (1, 5))
    assert one == two and one[77] is None and len({tuple(t) for t in one.values() if t}) > 1
    assert all(set(t) <= {0.0, 1.0} for t in one.values() if t)
    still = {r["k"]: r["tile"] for r in warps.random_perspective(df, "k", "t", 8, 8, 3, share=0.0).collect()}
    assert all(np.allclose(still[k], [float(i % 8 > 3) for i in range(64)]) for k in range(20))


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_warp_equals_each_pixel_by_itself(spark, method):
    random = np.random.default_rng(4)
    v = {(y, x): float(random.random()) for y in range(23) for x in range(31) if random.random() < 0.8}
    rows = [(y, x, z) for (y, x), z in v.items()] + [(0, 30, None)]
    v.pop((0, 30), None)
    rows = [r for r in rows if r[:2] != (0, 30) or r[2] is None]
    out = warps.warp(spark.createDataFrame(rows, "y long, x long, v double"), 20, 40, lambda y, x: (y * 1.3 - 1.0 + x * 0.05, x * 0.85 - 1.5 - y * 0.02), method=method, size=7)
    got = {(r["y"], r["x"]): r["v"] for r in out.collect()}
    for y in range(20):
        for x in range(40):
            sy, sx = y * 1.3 - 1.0 + x * 0.05, x * 0.85 - 1.5 - y * 0.02
            if method == "nearest":
                want = v.get((math.floor(sy + 0.5), math.floor(sx + 0.5)))
            else:
                near = [((1 - abs(sy - j)) * (1 - abs(sx - i)), v.get((j, i))) for j in (math.floor(sy), math.floor(sy) + 1) for i in (math.floor(sx), math.floor(sx) + 1)]
                near = [(w, z) for w, z in near if w > 0 and z is not None]
                want = sum(w * z for w, z in near) / sum(w for w, _ in near) if near else None
            assert (got.get((y, x)) is None) == (want is None) and (want is None or abs(got[y, x] - want) < 1e-9), (y, x)


def test_mercator_and_pixel_index_there_and_back(spark):
    rows = [(float(lon), float(lat)) for lon in (-179, -3, 0, 45, 120) for lat in (-80, -10, 0, 33, 79)]
    gt = (0.2, 0.01, 10.0, -0.02, -0.3, 50.0)
    df = spark.createDataFrame(rows, "lon double, lat double")
    back = geometry.from_web_mercator(*geometry.web_mercator(F.col("lon"), F.col("lat")))
    index = geometry.index_of(gt, *geometry.apply_affine(gt, F.col("lon"), F.col("lat")))
    for r in df.select("lon", "lat", *[c.alias(f"c{k}") for k, c in enumerate((*back, *index))]).collect():
        assert np.allclose([r["c0"], r["c1"], r["c2"], r["c3"]], [r["lon"], r["lat"]] * 2)
    known = spark.range(1).select(*geometry.web_mercator(F.lit(180.0), F.lit(0.0))).first()
    assert abs(known[0] - 20037508.342789244) < 1e-6 and abs(known[1]) < 1e-6


@pytest.mark.parametrize("ring,share", [
    ([(0, 0), (90, 0), (0, 90), (0, 0)], 1 / 8),
    ([(0, 0), (0, 90), (90, 0), (0, 0)], 1 / 8),
    ([(0, 60), (120, 60), (240, 60), (0, 60)], None),
    ([(170, -10), (-170, -10), (-170, 10), (170, 10), (170, -10)], None),
    ([(0, 0), (90, 0), (180, 0), (270, 0), (0, 0)], 1 / 2),
    ([(5, 5), (5, 5), (5, 5), (5, 5)], 0),
])
def test_areas_on_the_sphere(spark, ring, share):
    points = [{"x": float(x), "y": float(y)} for x, y in ring]
    got = spark.createDataFrame([(points,)], "r array<struct<x: double, y: double>>").select(geometry.sphere_area(F.col("r"), 1.0)).first()[0]
    if share is None:  # by the angles of the polygon between great circles
        v = [np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))]) for x, y in ring[:-1]]
        total = 0.0
        for k in range(len(v)):
            a, b, c = v[k - 1], v[k], v[(k + 1) % len(v)]
            p, q = np.cross(b, a), np.cross(b, c)
            total += math.acos(np.dot(p, q) / np.linalg.norm(p) / np.linalg.norm(q))
        assert abs(got - (total - (len(v) - 2) * math.pi)) < 1e-9
    else:
        assert abs(got - share * 4 * math.pi) < 1e-9


def scalar_clahe(values, grid, limit):
    """The definition, a pixel at a time."""
    h, w = values.shape
    ph, pw = -(-h // grid[0]), -(-w // grid[1])
    mirror = lambda k, n: k if k < n else 2 * (n - 1) - k
    maps = {}
    for j in range(grid[0]):
        for i in range(grid[1]):
            counts = [0] * 256
            for y in range(j * ph, (j + 1) * ph):
                for x in range(i * pw, (i + 1) * pw):
                    counts[values[mirror(y, h), mirror(x, w)]] += 1
            if limit > 0:
                top = max(int(limit * ph * pw / 256), 1)
                over = sum(max(c - top, 0) for c in counts)
                counts = [min(c, top) + over // 256 for c in counts]
                rest, step = over % 256, max(256 // (over % 256), 1) if over % 256 else 1
                k = 0
                while k < 256 and rest:
                    counts[k] += 1
                    rest -= 1
                    k += step
            total, own = 0, []
            for c in counts:
                total += c
                own.append(min(max(round(total * 255 / (ph * pw)), 0), 255))
            maps[j, i] = own
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = y / ph - 0.5, x / pw - 0.5
            j, i = math.floor(fy), math.floor(fx)
            sum_ = 0.0
            for dj, wj in ((0, 1 - fy + j), (1, fy - j)):
                for di, wi in ((0, 1 - fx + i), (1, fx - i)):
                    sum_ += wj * wi * maps[min(max(j + dj, 0), grid[0] - 1), min(max(i + di, 0), grid[1] - 1)][values[y, x]]
            out[y, x] = round(sum_)
    return out


@pytest.mark.parametrize("shape,grid,limit", [((8, 8), (2, 2), 2.0), ((16, 12), (4, 3), 1.0), ((9, 7), (2, 2), 40.0), ((12, 12), (1, 1), 0.0), ((16, 16), (4, 4), 8.0)])
def test_clahe_equals_the_definition(shape, grid, limit):
    random = np.random.default_rng(sum(shape))
    values = (random.random(shape) ** 3 * 255).astype(int)
    assert np.abs(contrast.clahe(values, grid, limit) - scalar_clahe(values, grid, limit)).max() <= 1  # sums of the same weights round apart at halves
    assert (contrast.clahe(values, grid, limit) != scalar_clahe(values, grid, limit)).mean() < 0.02


def test_colours_are_kept():
    random = np.random.default_rng(2)
    rgb = random.random((40, 3))
    assert np.allclose(contrast.lab_to_rgb(contrast.rgb_to_lab(rgb)), rgb, atol=1e-5)
    assert np.allclose(contrast.yuv_to_rgb(contrast.rgb_to_yuv(rgb)), rgb, atol=1e-9)
    assert np.allclose(contrast.rgb_to_lab(np.array([[1.0, 1, 1], [0, 0, 0]])), [[100, 0, 0], [0, 0, 0]], atol=0.02)
    assert np.allclose(contrast.rgb_to_lab(np.array([1.0, 0, 0])), [53.24, 80.09, 67.2], atol=0.05)
    tile = random.random((4, 8, 8)) * 0.4 + 0.3
    for out in (contrast.clahe_rgb(tile, (2, 2), 2.0), contrast.equalize_rgb(tile)):
        assert out.shape == tile.shape and np.array_equal(out[3], tile[3]) and (out >= 0).all() and (out <= 1).all()
    small = np.stack([np.full((4, 4), c) for c in (0.2, 0.4, 0.6, 0.9)])
    before, after = (contrast.rgb_to_lab(np.moveaxis(t[:3], 0, -1)) for t in (small, contrast.clahe_rgb(small, (2, 2), 1.0)))
    assert after[..., 0].std() < 1e-6
    inside = np.all((contrast.clahe_rgb(small, (2, 2), 1.0)[:3] > 0) & (contrast.clahe_rgb(small, (2, 2), 1.0)[:3] < 1))
    assert not inside or np.allclose(before[..., 1:], after[..., 1:], atol=1e-4)
