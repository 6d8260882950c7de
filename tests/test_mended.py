"""Answers that were wrong once, and plans that had one large group."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gridloom.operators import grid, selection, spatial, zonal
from gridloom.plans.inference import predict
from gridloom.session import forget, shared_folder, stored

BOX = "id long, yr long, ix0 long, iy0 long, ix1 long, iy1 long"


def test_window_range_of_rasters_smaller_than_a_patch(spark):
    rows = [(1, 20, 20), (2, 64, 20), (3, 20, 64), (4, 64, 64), (5, 130, 100)]
    out = grid.window_range(spark.createDataFrame(rows, "r long, h long, w long"), 64, 32, 0, 6).select("r", "patch_idx", "row_off", "col_off").collect()
    want = [(4, 0, 0, 0)] + [(5, k, k // 2 * 32, k % 2 * 32) for k in range(6)]
    assert sorted(map(tuple, out)) == want


def test_overlay_skips_missing_predictions(spark):
    nan = float("nan")
    rows = [(1, 1, 0.5), (1, 2, None), (2, 1, 0.5), (2, 2, nan), (3, 1, nan), (3, 2, 0.5), (3, 3, 1.0), (4, 1, None), (4, 2, nan), (5, 1, 0.25), (5, 2, 0.75)]
    df = spark.createDataFrame(rows, "k long, seq long, v double")
    got = {m: {r["k"]: r["v"] for r in zonal.overlay(df, ["k"], m).collect()} for m in zonal.OVERLAYS}
    fold = {}
    for k, _, v in rows:  # nanmean of what is there and the new one, from 0
        fold[k] = fold.get(k, 0.0) if v is None or np.isnan(v) else (fold.get(k, 0.0) + v) / 2
    assert got["MEAN"] == fold == {1: 0.25, 2: 0.25, 3: 0.625, 4: 0.0, 5: 0.4375}
    assert got["MAX"] == {1: 0.5, 2: 0.5, 3: 1.0, 4: None, 5: 0.75}
    assert got["MIN"] == {1: 0.5, 2: 0.5, 3: 0.5, 4: None, 5: 0.25}
    assert got["REPLACE"][1] is None and np.isnan(got["REPLACE"][2]) and got["REPLACE"][3] == 1.0


def test_coverage_counts_each_footprint_by_itself(spark):
    rows = [(1, 2002, 0, 0, 10, 10), (2, 2001, 0, 0, 10, 10), (2, 2001, 50, 50, 60, 60), (3, 2001, 0, 0, 9, 20), (4, 2000, 50, 50, 60, 60), (4, 2000, 50, 50, 60, 60), (5, 2000, 49, 50, 60, 60)]
    out = selection.coverage_select(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(map(tuple, out)) == [rows[0], rows[2], rows[3], rows[6]]
    assert selection.coverage_select(spark.createDataFrame([], BOX)).count() == 0


def test_predictor_modes(spark):
    tiles = spark.createDataFrame([(1, [0.2, 0.5, 0.9, 0.1])], "tile_id long, data array<double>")
    same = lambda: lambda batch: batch[:, 0]
    two = lambda: lambda batch: np.stack([1 - batch[:, 0], batch[:, 0], batch[:, 0] * 0 + 0.5], 1)
    run = lambda make, mode: predict(tiles, make, 2, 2, 1, scale=1.0, mode=mode).first()["tile"]
    assert run(same, "sigmoid") == [0, 0, 1, 0] and run(same, "ensemble") == [0, 1, 1, 0]
    assert run(two, "argmax") == [0, 0, 1, 0]
    with pytest.raises(ValueError, match="mode"):
        run(same, "soft")


def test_one_wide_box_makes_few_cells_and_all_pairs(spark):
    random = np.random.default_rng(0)
    rows = [(k, *map(float, (x := random.integers(0, 3000, 2))), *map(float, x + random.integers(0, 40, 2) * 10 ** int(random.integers(0, 3)))) for k in range(250)]
    rows += [(1000, 0.0, 0.0, 200_000.0, 200_000.0), (1001, 5.0, 5.0, 5.0, 5.0), (1002, 9.0, 9.0, 8.0, 9.0)]
    kind = "{0}id long, {0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"
    one, two = (spark.createDataFrame(rows, kind.format(p)) for p in ("", "b_"))
    box, other = ("x0", "y0", "x1", "y1"), ("b_x0", "b_y0", "b_x1", "b_y1")
    good = [r for r in rows if r[3] >= r[1] and r[4] >= r[2]]
    test = {
        "intersects": lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4],
        "within": lambda a, b: a[1] >= b[1] and a[3] <= b[3] and a[2] >= b[2] and a[4] <= b[4],
        "covers": lambda a, b: a[1] <= b[1] and a[3] >= b[3] and a[2] <= b[2] and a[4] >= b[4],
    }
    for predicate, holds in test.items():
        found = sorted(map(tuple, spatial.box_join(one, two, box, other, predicate=predicate, cell=10.0).select("id", "b_id").collect()))
        assert found == sorted((a[0], b[0]) for a in good for b in good if holds(a, b)), predicate
    own = spatial._cells(one, box, 10.0, F.array(spatial._level(box, 10.0)))
    assert own.groupBy("id").count().agg(F.max("count")).first()[0] <= 9


def test_weighted_sample_with_one_heavy_row(spark):
    rows = [(k, 1.0) for k in range(500)] + [(1000, 10.0**6), (2000, 0.0)]
    got = selection.weighted_sample(spark.createDataFrame(rows, "k long, w double").repartition(7), "k", "w", 3000, 5).collect()
    starts = np.cumsum([0] + [round(w * 1000) for k, w in sorted(rows) if w])
    keys = [k for k, w in sorted(rows) if w]
    import hashlib

    want = {j: keys[int(np.searchsorted(starts, int(int(hashlib.md5(f"5-{j}".encode()).hexdigest()[:8], 16) / 2**32 * starts[-1]), "right")) - 1] for j in range(3000)}
    assert {r["draw"]: r["k"] for r in got} == want and len(got) == 3000


def test_blocks_give_a_trailing_window_all_its_rows(spark):
    random = np.random.default_rng(1)
    rows = [(int(k), int(random.integers(0, 2)) if k % 50 else 7, float(random.random())) for k in range(900)]
    cut = grid.within_blocks(spark.createDataFrame(rows, "k long, g long, v double"), "g", ["k"], 9, block=20)
    w = Window.partitionBy("g", "_block").orderBy("row_idx").rowsBetween(-9, 0)
    got = {r["k"]: r["s"] for r in cut.withColumn("s", F.sum("v").over(w)).where("not _halo").select("k", "s").collect()}
    assert cut.groupBy("g", "_block").count().agg(F.max("count")).first()[0] <= 29
    for g in (0, 1, 7):
        own = [(k, v) for k, h, v in rows if h == g]
        for i, (k, _) in enumerate(own):
            assert np.isclose(got[k], sum(v for _, v in own[max(0, i - 9) : i + 1]))


def test_stored_tables_are_deleted(spark):
    import glob
    import os

    df = stored(spark.range(5), "probe")
    at = df.stored_at.removeprefix("file:")
    assert df.count() == 5 and at.startswith(shared_folder(spark).removeprefix("file:")) and os.path.isdir(at)
    forget(df)
    assert not glob.glob(at)
