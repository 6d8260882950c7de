"""Writers and readers of layers, configs and scores."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.operators.spatial import in_box
from gridloom.sources import files

BOX = ("x0", "y0", "x1", "y1")


def layer(spark, n=20_000):
    random = np.random.default_rng(0)
    x, y = random.random(n) * 1000, random.random(n) * 1000
    return spark.createDataFrame([(k, float(a), float(b), float(a) + 2, float(b) + 3) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x0 double, y0 double, x1 double, y1 double")


def met(path, box):
    """Files whose statistics allow a row that meets the box, and all files."""
    hit = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        stats = [{n: meta.row_group(g).column(names.index(n)).statistics for n in BOX} for g in range(meta.num_row_groups)]
        total += 1
        hit += any(s["x0"].min <= box[2] and s["x1"].max >= box[0] and s["y0"].min <= box[3] and s["y1"].max >= box[1] for s in stats)
    return hit, total


def test_a_box_filter_skips_most_files_of_a_clustered_layer(spark, tmp_path):
    df = layer(spark)
    plain, curve = str(tmp_path / "plain"), str(tmp_path / "curve")
    df.repartition(32).write.parquet(plain)
    assert files.write_clustered(df, curve, BOX, files=32)
    box = (400.0, 300.0, 460.0, 350.0)
    assert met(plain, box) == (32, 32)
    hit, total = met(curve, box)
    assert total == 32 and hit <= 6
    found = [sorted(r["id"] for r in spark.read.parquet(p).where(in_box(BOX, *box)).collect()) for p in (plain, curve)]
    assert found[0] == found[1] and found[0]
    read = spark.read.parquet(curve).where(in_box(BOX, *box))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(x0" in plan
    assert not files.write_clustered(df.limit(0), str(tmp_path / "none"), BOX)


def test_curve_places_lay_bits_in_turn(spark):
    rows = [(k, float(x), float(y), float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (65535, 65535), (5, 3)])]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    got = [r[0] for r in df.select(files.curve_key(BOX, (0.0, 0.0, 65535.0, 65535.0)), "id").orderBy("id").collect()]
    assert got == [0, 1, 2, 3, 4, (1 << 32) - 1, 0b011011]


def test_configs_there_and_back(spark, tmp_path):
    files.write_config(spark, str(tmp_path / "one"), {"patch_size": [256, 256], "loss_fn": "tversky"})
    files.write_config(spark, str(tmp_path / "two"), {"loss_fn": "dice", "splits": {"train": ["a"], "val": []}})
    rows = {r["loss_fn"]: r for r in files.read_configs(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert set(rows) == {"tversky", "dice"} and rows["dice"]["patch_size"] is None and rows["dice"]["splits"]["train"] == ["a"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_config(spark, str(tmp_path / "one"), {})


def test_scores_of_runs(spark, tmp_path):
    base = str(tmp_path / "scores")
    kind = "patch_id long, yr long, iou double, dice double"
    one = spark.createDataFrame([(1, 2020, 0.5, 0.6), (2, 2020, 0.7, 0.8), (3, 2021, 1.0, None)], kind)
    log = [r["line"] for r in files.write_scores(one, base, "unet", "run_1", ["iou", "dice"], by="yr").collect()]
    assert log == ["2020: 2 patches iou 0.600000 dice 0.700000", "2021: 1 patches iou 1.000000 dice null", "all: 3 patches iou 0.733333 dice 0.700000"]
    files.write_scores(one.limit(1), base, "other", "run_2", ["iou"])
    back = files.read_scores(spark, base, kind).collect()
    assert sorted((r["model"], r["run"], r["patch_id"]) for r in back) == [("other", "run_2", 1), ("unet", "run_1", 1), ("unet", "run_1", 2), ("unet", "run_1", 3)]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_scores(one, base, "unet", "run_1", ["iou"])


def test_tiles_there_and_back_and_ordinals(spark, tmp_path):
    from gridloom.sources.schemas import SCHEMAS

    rows = [(k, 2000 + k % 2, 2, 2, 1, [k, 0, -1, 7]) for k in range(6)]
    df = spark.createDataFrame(rows, "tile_id long, year long, h int, w int, bands int, data array<smallint>")
    files.save_tiles(df, str(tmp_path / "tiles"))
    files.save_tiles(df.limit(1), str(tmp_path / "tiles"))  # stays as it is
    back = files.load_tiles(spark, str(tmp_path / "tiles"))
    assert sorted(map(tuple, back.select("tile_id", "year", "h", "w", "bands", "data").collect())) == sorted(rows) and SCHEMAS["tiles"]
    files.save_tiles(df.limit(1), str(tmp_path / "tiles"), overwrite=True)
    assert files.load_tiles(spark, str(tmp_path / "tiles")).count() == 1
    out = sorted(map(tuple, files.with_ordinal(df.select("tile_id", "year"), "year", "tile_id").select("year", "tile_id", "ordinal").collect()))
    assert out == [(2000, 0, 1), (2000, 2, 2), (2000, 4, 3), (2001, 1, 1), (2001, 3, 2), (2001, 5, 3)]
