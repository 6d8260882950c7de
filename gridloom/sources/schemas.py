"""Declared schemas of the engine's input tables, as DDL."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "raster_meta": "raster_id BIGINT, path STRING, year BIGINT, width INT, height INT, bands INT, dtype STRING, nodata DOUBLE, transform ARRAY<DOUBLE>, crs STRING, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE",
    "regions": "shape_id BIGINT, name STRING, start_idx BIGINT, grid_shape STRUCT<ny:INT,nx:INT>, padding INT, width DOUBLE, height DOUBLE, rescale_factor INT, patch_size ARRAY<INT>, cutout_shape ARRAY<INT>, transform ARRAY<DOUBLE>, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
    "patches": "patch_idx BIGINT, shape_id BIGINT, col_off DOUBLE, row_off DOUBLE, width INT, height INT",
    "window_index": "file STRING, w_x INT, w_y INT, w_patch INT, h_patch INT",
    "tiles": "tile_id BIGINT, year BIGINT, h INT, w INT, bands INT, data ARRAY<SMALLINT>",
    "pixels": "patch_id BIGINT, year BIGINT, y INT, x INT, prob DOUBLE, p INT, t INT",
    "tree_labels": "label_id BIGINT, geom_wkb BINARY, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
    "areas": "area_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
    "footprints": "id STRING, year BIGINT, y_idx BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
    "crowns": "crown_id BIGINT, cx DOUBLE, cy DOUBLE, area DOUBLE",
    "predictions": "id BIGINT, run_name STRING, status STRING, priority INT, mosaic_fp STRING, config STRING, gpu_id STRING, time_start STRING, output_fp STRING, time_elapsed_m DOUBLE, msg STRING",
    "patch_scores": "patch_id BIGINT, year BIGINT, acc DOUBLE, iou DOUBLE, dice DOUBLE, rmse_cov DOUBLE",
    "epoch_log": "run STRING, epoch INT, phase STRING, batch INT, n INT, loss DOUBLE, iou DOUBLE",
    "feature_vectors": "vec_id BIGINT, v ARRAY<FLOAT>",
}
