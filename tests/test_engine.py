"""Sources, plans, streaming and grids on small cases, and the recorded evaluation as an arithmetic check."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid, selection, spatial
from gridloom.plans import inference
from gridloom.sources import files
from gridloom.streaming import work_queue


def test_grid_is_empty_for_a_region_smaller_than_a_step(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 10)], "r int, y0 long, x0 long, h long, w long")
    assert grid.patch_grid(df, 256, 0, 0).count() == 0
    assert grid.patchify(df, 10, 5).count() == 1


@pytest.mark.parametrize("n,k", [(0, 3), (1, 4), (7, 3), (10, 4), (23, 8)])
def test_balanced_split_sizes(spark, n, k):
    rows = grid.balanced_split(spark.range(n), k, ["id"]).collect()
    want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["id"])] == want


def test_box_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(1)
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(-50, 50, 60), rng.integers(-50, 50, 60), rng.integers(0, 40, 60), rng.integers(0, 40, 60), strict=True))]
    a = spark.createDataFrame(boxes, "a long, x0 double, y0 double, x1 double, y1 double")
    b = spatial.prefixed(a, "b_")
    pairs = [tuple(r) for r in spatial.box_join(a, b, ("x0", "y0", "x1", "y1"), ("b_x0", "b_y0", "b_x1", "b_y1"), cell=13.0).select("a", "b_a").collect()]
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_numbering_is_exact_over_many_partitions(spark):
    n = 3_000_000
    df = spark.range(n, numPartitions=8).select((F.xxhash64("id") % 1_000_003).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("extra"), F.lit(2).alias("two"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = grid.numbered(df, ["k", "id"])
        one = got.agg(F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx"), F.min("n_rows"), F.max("n_rows")).first()
        assert tuple(one) == (n, 0, n - 1, n, n)
        first = got.where("row_idx < 1000").orderBy("row_idx").select("k", "id").collect()
        assert first == sorted(first)
        sums = grid.prefix_offsets(df, "two", ["k", "id"])
        assert tuple(sums.agg(F.countDistinct("start_idx"), F.min("start_idx"), F.max("start_idx"), F.max(F.col("start_idx") % 2)).first()) == (n, 0, 2 * n - 2, 0)
        groups = grid.numbered_within(df.withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)), "g", ["k", "id"])
        by = groups.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d"), F.max("row_idx").alias("hi"), F.max("n_rows").alias("r"), F.min("n_rows").alias("s")).collect()
        assert sum(r["n"] for r in by) == n and all(r["n"] == r["d"] == r["hi"] + 1 == r["r"] == r["s"] for r in by)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shuffle", ["none", "order", "deal", "group"])
def test_semi_and_anti_joins_after_a_shuffle(spark, shuffle):
    points = spark.range(20_000, numPartitions=5).select("id", (F.xxhash64("id") % 1000).cast("double").alias("x"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("y"))
    points = points.unionAll(points.where("id % 100 = 0")).withColumn("note", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("n")))
    boxes = spark.createDataFrame([(k, 130.0 * k - 900, 90.0 * k - 900, 130.0 * k - 700, 90.0 * k - 500) for k in range(14)], "b long, bx0 double, by0 double, bx1 double, by1 double")
    left = {"none": points, "order": points.orderBy("y", "id"), "deal": points.repartition(8), "group": points.groupBy("id", "x", "y", "note").agg(F.count("*").alias("n"))}[shuffle]
    held = boxes.collect()
    want = {r["id"]: any(b["bx0"] <= r["x"] <= b["bx1"] and b["by0"] <= r["y"] <= b["by1"] for b in held) for r in points.collect()}
    total = left.count()
    args = (boxes, ("x", "y", "x", "y"), ("bx0", "by0", "bx1", "by1"))
    semi = [r["id"] for r in spatial.box_join(left, *args, how="left_semi").collect()]
    anti = [r["id"] for r in spatial.box_join(left, *args, how="left_anti").collect()]
    assert all(want[k] for k in semi) and not any(want[k] for k in anti) and len(semi) + len(anti) == total and semi and anti


def test_weighted_total_is_the_patch_mean(spark):
    """The year means weighted by their patches are the means over all patches that aren't true-empty, on real patches."""
    from gridloom import queries as Q
    from gridloom.sources.bridge import view

    px = view(spark, "/root/testdata/sf0.001", "px")
    total = Q.QUERIES["weighted_total"](spark, "/root/testdata/sf0.001").first()
    kept = Q.patch_scores(px).where("iou <> 1.0").toPandas()
    for name in ("acc", "iou", "dice", "rmse_cov"):
        assert abs(total[name] - kept[name].mean()) < 1e-6


def test_early_stop_counts_since_the_last_improvement(spark):
    log = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "run string, epoch int, m double")
    assert [r["stale"] for r in selection.early_stop(log, "run", "epoch", "m").orderBy("epoch").collect()] == [0, 0, 1, 2, 0]


def test_geojson_boxes_and_multipolygons(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]
    far = [[[9, 9], [10, 9], [10, 11], [9, 9]]]
    features = [{"type": "Feature", "properties": {"id": "1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"id": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], far]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = files.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted((r["properties"]["id"], r["x1"], r["y1"]) for r in rows) == [("1", 2.0, 3.0), ("2", 2.0, 3.0), ("2", 10.0, 11.0)]


def test_windows_outside_a_tile_take_the_fill(spark):
    tiles = spark.createDataFrame([(1, 2020, 2, 2, 1, [1, 2, 3, 4])], files.SCHEMAS["tiles"])
    windows = spark.createDataFrame([(0, 1, -1.0, 0.0, 2, 2)], "patch_idx long, tile_id long, col_off double, row_off double, width int, height int")
    got = {(r["wy"], r["wx"]): r["v"] for r in files.read_windows(tiles, windows, fill=9).collect()}
    assert got == {(0, 0): 9, (0, 1): 1, (1, 0): 9, (1, 1): 3}


def test_image_source_needs_exactly_one():
    with pytest.raises(ValueError):
        files.ImageSource()
    with pytest.raises(ValueError):
        files.ImageSource(file="a", folder="b")


def test_listing_and_csv_cache(spark, tmp_path):
    for name in ("b.tif", "a.tif", "c.txt"):
        (tmp_path / name).write_text(name)
    found = [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), "*.tif").collect()]
    assert found == ["a.tif", "b.tif"]
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), build, "id long").count() == 3
    assert len(calls) == 1


def test_inference_to_maps(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k // 2, k % 2, rng.integers(0, 255, 3 * 64).tolist()) for k in range(4)]
    tiles = spark.createDataFrame(rows, "tile_id long, gy long, gx long, data array<int>")
    mask = inference.mosaic_mask(tiles, tiles, lambda: inference.excess_green, 8, 2, 7, 8, 3)
    got = {(r["y"], r["x"]): r["v"] for r in mask.collect()}
    assert len(got) == 7 * 8
    for k, gy, gx, data in rows:
        want = inference.excess_green(np.array(data).reshape(1, 3, 8, 8) / 255)[0][2:6, 2:6]
        for y, x in np.ndindex(4, 4):
            if gy * 4 + y < 7:
                assert got[gy * 4 + y, gx * 4 + x] == want[y, x]
    density, cover = inference.map_products(mask, 8, 1.0, 4.0, [1, 3])
    assert density.agg({"band1": "sum"}).first()[0] > 0 and cover.count() == 4


def test_work_queue_runs_by_priority_and_logs_errors(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    work_queue.append(spark, log, [(1, "r", 1, 0, "queued", None), (2, "r", 5, 0, "queued", None), (3, "s", 9, 0, "queued", None)])

    def process(entry):
        seen.append(entry)
        if entry == 1:
            raise RuntimeError("no")

    assert work_queue.work(spark, log, "r", process) == 1
    assert seen == [2, 1]
    assert {r["id"]: r["status"] for r in work_queue.current(spark, log).collect()} == {1: "error", 2: "completed", 3: "queued"}
    query = work_queue.stream_status(spark, log, "status_now")
    query.processAllAvailable()
    query.stop()
    assert {r["id"]: r["status"] for r in spark.table("status_now").collect()} == {1: "error", 2: "completed", 3: "queued"}


def test_stream_keeps_the_best(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([(1, 0.1), (2, 0.9)], [(3, 0.5), (4, 0.95)]):
        spark.createDataFrame(part, "k int, m double").coalesce(1).write.mode("append").parquet(source)
    scores = spark.readStream.schema("k int, m double").option("maxFilesPerTrigger", 1).parquet(source)
    query = work_queue.stream_best(spark, scores, str(tmp_path / "out"), "m", "k", 2)
    query.processAllAvailable()
    query.stop()
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "out" / "1")).orderBy("k").collect()] == [2, 4]


def test_whole_mosaic_holds_every_tile(spark, small):
    from gridloom.queries import QUERIES

    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    out = QUERIES["unpatchify_whole"](spark, small)
    assert n > 16 and out.count() == out.select("y", "x").distinct().count() == 16 * n


def test_whole_joins_leave_no_row_out(spark, small):
    from gridloom.queries import QUERIES
    from gridloom.sources.bridge import view

    rects, boxes = (view(spark, small, x).collect() for x in ("rects", "boxes"))
    meet = lambda a, b: a["x0"] <= b["x1"] and b["x0"] <= a["x1"] and a["y0"] <= b["y1"] and b["y0"] <= a["y1"]
    inside = lambda a, b: a["x0"] < b["x1"] and b["x0"] < a["x1"] and a["y0"] < b["y1"] and b["y0"] < a["y1"]
    lists = {r["rect_id"]: r["areas"] for r in QUERIES["image_area_lists_whole"](spark, small).collect()}
    assert lists == {r["rect_id"]: want for r in rects if (want := sorted(b["box_id"] for b in boxes if meet(r, b)))}
    alone = sorted(r["box_id"] for r in QUERIES["anti_overlap_whole"](spark, small).collect())
    assert alone == sorted(b["box_id"] for b in boxes if not any(meet(r, b) for r in rects))
    pairs = sorted((r["a"], r["b"]) for r in QUERIES["mask_intersection_whole"](spark, small).collect())
    assert pairs == sorted((a["rect_id"], b["rect_id"]) for a in rects for b in rects if a["rect_id"] != b["rect_id"] and inside(a, b))
