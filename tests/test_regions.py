"""Components across tiles and their polygons, against flood fill and pixel counts."""

import numpy as np
import pytest

from gridloom.operators import tiles
from gridloom.operators.graph import connected
from gridloom.operators.regions import ROW, Regions, link, tile_corners


def flood(mask):
    label = np.zeros(mask.shape, np.int64)
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        label[start], stack = start[0] * ROW + start[1] + 1, [start]
        while stack:
            y, x = stack.pop()
            for at in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not label[at]:
                    label[at] = label[start]
                    stack.append(at)
    return label


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:], strict=True)) / 2


def spiral(n):
    """One path that winds through the whole mask, with walls of one pixel."""
    mask = np.zeros((n, n), bool)
    top, left, low, right = 0, 0, n - 1, n - 1
    while top <= low and left <= right:
        mask[top, left : right + 1] = mask[top : low + 1, right] = True
        mask[low, left + 2 : right + 1] = True
        mask[top + 2 : low + 1, left + 2] = True
        top, left, low, right = top + 2, left + 2, low - 2, right - 2
    return mask


def test_tile_components_equal_flood_fill():
    random = np.random.default_rng(3)
    for _ in range(200):
        h, w = random.integers(1, 20, 2)
        mask = random.random((h, w)) < random.random()
        want = flood(mask)
        first = np.where(want > 0, (want - 1) // ROW * w + (want - 1) % ROW + 1, 0)
        assert np.array_equal(tiles.components(mask), first)


def test_rings_of_random_tiles():
    random = np.random.default_rng(5)
    for _ in range(150):
        n = int(random.integers(2, 14))
        labels = tiles.components(random.random((n, n)) < random.random())
        label, y, x, around = tile_corners(labels)
        for one in np.unique(labels[labels > 0]):
            own = (label == one) & ~np.isin(around, (0, 3, 5, 10, 12, 15))
            areas = [shoelace(r) for r in link(y[own], x[own], around[own])]
            assert sum(areas) == (labels == one).sum() and areas[0] > 0 and all(a < 0 for a in areas[1:])


@pytest.mark.parametrize("kind,size", [("random", 5), ("spiral", 7), ("grid", 4)])
def test_regions_of_a_raster_equal_flood_fill(spark, kind, size):
    random = np.random.default_rng(size)
    mask = {"random": random.random((41, 37)) < 0.57, "spiral": spiral(33), "full": np.ones((20, 30), bool), "grid": np.indices((13, 13)).sum(0) % 2 == 0}[kind]
    rows = [(int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(mask)] + [(0, 0, None)]
    found = Regions(spark.createDataFrame(rows, "y long, x long, v int"), size)
    want = flood(mask)
    assert {(r["y"], r["x"]): r["component"] for r in found.pixels().collect()} == {(int(y), int(x)): int(v) for (y, x), v in np.ndenumerate(want) if v}
    stats = {r["component"]: r for r in found.stats().collect()}
    assert set(stats) == set(want[want > 0].tolist())
    for one, r in stats.items():
        y, x = np.nonzero(want == one)
        assert r["n"] == len(y) and np.isclose(r["cx"], x.mean() + 0.5) and np.isclose(r["cy"], y.mean() + 0.5)
    for r in found.polygons().collect():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
        assert all(ring[0] == ring[-1] for ring in rings)
        assert sum(map(shoelace, rings)) == (want == r["component"]).sum()
        assert shoelace(rings[0]) > 0 and all(shoelace(ring) < 0 for ring in rings[1:])
        drawn = np.zeros(mask.shape, bool)
        centres = np.mgrid[: mask.shape[0], : mask.shape[1]] + 0.5
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:], strict=True):
                if y0 != y1:
                    drawn ^= ((y0 > centres[0]) != (y1 > centres[0])) & (centres[1] < x0)
        assert np.array_equal(drawn, want == r["component"])


def test_empty_raster(spark):
    found = Regions(spark.createDataFrame([(0, 0, 0)], "y long, x long, v int"), 8)
    assert found.pixels().count() == found.stats().count() == found.polygons().count() == 0


def test_connected_finds_the_least_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(200, 290)] + [(290, 290), (None, 3), (1 << 60, -5), (-5, 1 << 60)]
    out = {r["id"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(101, 181)} | {k: 7 for k in range(200, 290)} | {1 << 60: -5}
    assert {k: v for k, v in out.items() if k != v} == want


def test_map_products_count_a_crown_across_tiles_once(spark):
    from gridloom.plans.inference import map_products

    rows = [(y, x, int(4 <= y < 8 and 2 <= x < 14)) for y in range(16) for x in range(16)]
    density, _ = map_products(spark.createDataFrame(rows, "y long, x long, v int"), 4, 1.0, 16.0, [3.0, 100.0])
    assert [(r["gx"], r["gy"], round(r["band1"] * 16**2 / 10000), round(r["band2"] * 16**2 / 10000)) for r in density.collect()] == [(0, 0, 1, 1)]
