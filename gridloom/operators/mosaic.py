"""Stitching of patches, components and boundaries over tiles of a pixel table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import tiles


def stitch(patches: DataFrame, patch: int, pad: int, height: int, width: int) -> DataFrame:
    """(y, x, v) of a mosaic of patches (gy, gx, tile): pad pixels go on each side, what lies outside is cut."""
    inner = patch - 2 * pad
    pixels = patches.select("gy", "gx", F.posexplode("tile").alias("i", "v")).withColumns({"iy": F.expr(f"i div {patch}"), "ix": F.col("i") % patch})
    pixels = pixels.where(F.col("iy").between(pad, patch - pad - 1) & F.col("ix").between(pad, patch - pad - 1))
    out = pixels.select((F.col("gy") * inner + F.col("iy") - pad).cast("bigint").alias("y"), (F.col("gx") * inner + F.col("ix") - pad).cast("bigint").alias("x"), F.col("v").cast("double").alias("v"))
    return out.where((F.col("y") < height) & (F.col("x") < width))


def stitch_tiles(patches: DataFrame, height: int, width: int, ny: int, nx: int, padding: tuple[int, int, int, int]) -> DataFrame:
    """(y0, x0, h, w, tile): the inner part of each patch (gy, gx, tile of height x width) at its place in the mosaic, as tiles.

    padding: rows cut from each side, rows cut below in the last row of patches, and the same two for columns. Patches outside
    ny x nx are left out. No row is made for a pixel."""
    top, last_row, left, last_column = padding
    inside = patches.where(F.col("gy").between(0, ny - 1) & F.col("gx").between(0, nx - 1))
    low, right = F.when(F.col("gy") == ny - 1, last_row).otherwise(top), F.when(F.col("gx") == nx - 1, last_column).otherwise(left)
    sized = inside.withColumns({"h": (height - top - low).cast("bigint"), "w": (width - left - right).cast("bigint")})
    cut = F.flatten(F.transform(F.sequence(F.lit(top), (F.col("h") + top - 1).cast("int")), lambda y: F.slice("tile", y * width + left + 1, F.col("w").cast("int"))))
    at = {"y0": (F.col("gy") * (height - 2 * top)).cast("bigint"), "x0": (F.col("gx") * (width - 2 * left)).cast("bigint")}
    return sized.withColumns(at).select("y0", "x0", "h", "w", cut.alias("tile"))


def tile_components(pixels: DataFrame, size: int) -> DataFrame:
    """4-neighbour components of set pixels (y, x, v) within size x size tiles: (ty, tx, y, x, label), the label being the
    smallest row-major position of the component, from 1. A tile is one bounded group."""

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((size, size), bool)
        mask[frame["y"] % size, frame["x"] % size] = True
        found = tiles.components(mask)
        return frame[["ty", "tx", "y", "x"]].assign(label=found[frame["y"] % size, frame["x"] % size])

    own = pixels.where("v = 1").select(F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    return own.groupBy("ty", "tx").applyInPandas(label, "ty bigint, tx bigint, y bigint, x bigint, label bigint")


def boundary_cells(boxes: DataFrame, grow: int) -> DataFrame:
    """Pixels that at least two grown boxes hold and no box itself: the gaps between close crowns."""

    def cells(df: DataFrame, by: int) -> DataFrame:
        span = lambda a, b: F.sequence((F.col(a) - by).cast("bigint"), (F.col(b) + by).cast("bigint") - 1)
        return df.select("box_id", F.explode(span("y0", "y1")).alias("y"), "x0", "x1").select("box_id", "y", F.explode(span("x0", "x1")).alias("x"))

    shared = cells(boxes, grow).groupBy("y", "x").agg(F.min("box_id").alias("a"), F.max("box_id").alias("b")).where("a <> b").select("y", "x")
    return shared.join(cells(boxes, 0).select("y", "x").distinct(), ["y", "x"], "left_anti")


def equalized_levels(pixels: DataFrame, group: str, level: str, top: int) -> DataFrame:
    """(group, level, v): the equalised value of each level by its cumulated count."""
    counts = pixels.groupBy(group, level).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    counts = counts.withColumns({"cdf": F.sum("n").over(w.orderBy(level)), "total": F.sum("n").over(w), "low": F.first("n").over(w.orderBy(level))})
    span = F.col("total") - F.col("low")
    v = F.when(span == 0, F.col(level).cast("double")).otherwise(F.round((F.col("cdf") - F.col("low")) / F.when(span == 0, 1).otherwise(span) * top))
    return counts.select(group, level, v.alias("v"))


def polygon_pixels(polygons: DataFrame, key: str, ring: str, h: int, w: int) -> DataFrame:
    """(key, y, x) of the pixels whose centre lies in a polygon, by ray casting."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, r in zip(frame[key], frame[ring], strict=True):
                y, x = np.nonzero(tiles.polygon_mask([tuple(p) for p in r], h, w))
                yield pd.DataFrame({key: k, "y": y.astype(np.int64), "x": x.astype(np.int64)})

    return polygons.select(key, ring).mapInPandas(run, f"{key} bigint, y bigint, x bigint")
