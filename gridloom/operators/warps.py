"""Resampling by inverse mapping: tiles by a fixed or a random geometry, and rasters from one coordinate system to another.

For a fixed geometry each target pixel is a weighted sum of a few source pixels, the same ones in every tile; places and
weights are literal arrays (bounded by the tile's size) and the sum is a higher-order function, without Python. A geometry of
each tile's own is a NumPy kernel in batches. A raster of any size is warped by tiles: each target pixel goes to the source
tile that its place falls in, which carries a halo of one pixel, so that the up to four neighbours are in one bounded group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .selection import uniform

#: Places and weights of the source pixels of each target pixel: two arrays (targets, sources a target). A place of -1 is
#: outside the tile.
Sources = tuple[np.ndarray, np.ndarray]


def bilinear_sources(y: np.ndarray, x: np.ndarray, h: int, w: int, *, clamp: bool = False) -> Sources:
    """The four pixels around each place (y, x), in pixel centres, of an h x w tile. clamp: places outside take the nearest
    side; else what is outside has no weight."""
    if clamp:
        y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y), np.floor(x)
    places, weights = [], []
    for dy in (0, 1):
        for dx in (0, 1):
            ny, nx = y0 + dy, x0 + dx
            weight = (1 - np.abs(y - ny)) * (1 - np.abs(x - nx))
            ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w) & (weight > 0)
            places.append(np.where(ok, ny * w + nx, -1).astype(np.int64).ravel())
            weights.append(np.where(ok, weight, 0.0).ravel())
    return np.stack(places, 1), np.stack(weights, 1)


def nearest_sources(y: np.ndarray, x: np.ndarray, h: int, w: int) -> Sources:
    """The pixel nearest to each place; half a pixel goes up."""
    ny, nx = np.floor(y + 0.5), np.floor(x + 0.5)
    ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
    return np.where(ok, ny * w + nx, -1).astype(np.int64).reshape(-1, 1), np.ones((y.size, 1))


def sampled(tile: Column, sources: Sources, fill: float = 0.0) -> Column:
    """A tile of the weighted sums of sources (doubles); fill where all of them are outside."""
    table = [{"s": s[s >= 0].tolist(), "w": w[s >= 0].tolist()} for s, w in zip(*sources, strict=True)]
    entries = F.from_json(F.lit(json.dumps(table)), "array<struct<s: array<int>, w: array<double>>>")

    def value(e: Column) -> Column:
        parts = F.zip_with(e["s"], e["w"], lambda s, w: F.get(tile, s).cast("double") * w)
        return F.when(F.size(e["s"]) == 0, F.lit(float(fill))).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))

    return F.when(tile.isNotNull(), F.transform(entries, value))


def applied(tile: np.ndarray, sources: Sources, fill: float = 0.0) -> np.ndarray:
    """sampled() of one tile in NumPy."""
    places, weights = sources
    found = np.where(places >= 0, tile.ravel()[np.maximum(places, 0)], 0.0)
    return np.where((places >= 0).any(1), (found * weights).sum(1), fill)


def resize_sources(h: int, w: int, oh: int, ow: int) -> Sources:
    """Bilinear resampling of h x w to oh x ow with half-pixel centres and clamped sides."""
    y, x = np.mgrid[:oh, :ow]
    return bilinear_sources((y + 0.5) * h / oh - 0.5, (x + 0.5) * w / ow - 0.5, h, w, clamp=True)


def rotation_sources(h: int, w: int, degrees: float) -> Sources:
    """Nearest rotation about the centre, counter-clockwise."""
    cy, cx, a = (h - 1) / 2, (w - 1) / 2, np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    return nearest_sources(cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a), cx - (y - cy) * np.sin(a) + (x - cx) * np.cos(a), h, w)


def homography(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four target points (x, y) to four source points; the last entry is 1."""
    rows, values = [], []
    for (x, y), (u, v) in zip(target, source, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1.0).reshape(3, 3)


def perspective_places(h: int, w: int, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of an h x w target lies in the source (y, x)."""
    y, x = np.mgrid[:h, :w].astype(float)
    d = matrix[2, 0] * x + matrix[2, 1] * y + matrix[2, 2]
    return (matrix[1, 0] * x + matrix[1, 1] * y + matrix[1, 2]) / d, (matrix[0, 0] * x + matrix[0, 1] * y + matrix[0, 2]) / d


def corner_points(h: int, w: int) -> np.ndarray:
    """The corners (x, y) of a tile in pixel centres."""
    return np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)


def perspective(tile: Column, h: int, w: int, source: np.ndarray, *, label: bool = False, fill: float = 0.0) -> Column:
    """The tile seen so that its corners show the source points (x, y) of the old one. Labels take the nearest pixel and are
    0 or 1 again (1 from a half on); other tiles are bilinear."""
    y, x = perspective_places(h, w, homography(corner_points(h, w), source))
    if label:
        return F.transform(sampled(tile, nearest_sources(y, x, h, w), fill), lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0))
    return sampled(tile, bilinear_sources(y, x, h, w), fill)


def jitter(tile: Column, brightness: float, contrast: float) -> Column:
    """Brightness, then contrast about the mean, clipped to [0, 1]."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    bright = F.transform(tile, lambda v: clip(v.cast("double") * brightness))
    held = F.array(F.struct(bright.alias("b"), (F.aggregate(bright, F.lit(0.0), lambda a, v: a + v) / F.size(bright)).alias("m")))
    return F.get(F.transform(held, lambda e: F.transform(e["b"], lambda v: clip((v - e["m"]) * contrast + e["m"]))), F.lit(0))


def corner_shifts(key: Column, seed: int, h: int, w: int, share: float) -> Column:
    """Source points of random corners: each moved inwards by up to share of the tile's sides, by hashes of key and seed."""
    at = lambda k, side: uniform(F.concat(key.cast("string"), F.lit(f"-{seed}-{k}"))) * share * (side - 1)
    points = []
    for k, (x, y) in enumerate(corner_points(h, w)):
        points += [F.lit(x) + (at(f"x{k}", w) if x == 0 else -at(f"x{k}", w)), F.lit(y) + (at(f"y{k}", h) if y == 0 else -at(f"y{k}", h))]
    return F.array(*points)


def random_perspective(df: DataFrame, key: str, tile: str, h: int, w: int, seed: int, *, share: float = 0.1, label: bool = False, out: str = "tile") -> DataFrame:
    """df with out: each tile by a perspective of its own (corner_shifts), in batches. Null tiles stay null."""
    kept = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)

    def one(values, points) -> list[float] | None:
        if values is None:
            return None
        y, x = perspective_places(h, w, homography(corner_points(h, w), np.asarray(points).reshape(4, 2)))
        own = np.asarray(values, np.float64)
        if label:
            return (applied(own, nearest_sources(y, x, h, w)) >= 0.5).astype(float).tolist()
        return applied(own, bilinear_sources(y, x, h, w)).tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[kept].assign(**{out: [one(*pair) for pair in zip(frame[tile], frame["_points"], strict=True)]})

    return df.withColumn("_points", corner_shifts(F.col(key), seed, h, w, share)).mapInPandas(run, f"{schema}, `{out}` array<double>")


def random_resized_crop(tile: Column, h: int, w: int, oh: int, ow: int, key: Column, seed: int, *, scale: tuple[float, float] = (0.5, 1.0), ratio: tuple[float, float] = (0.75, 4 / 3), label: bool = False) -> Column:
    """A part of the tile, of a share of its area in scale and of a ratio of sides in ratio (even in its logarithm), at a
    random place, resampled to oh x ow: bilinear, or nearest for labels. All four choices are hashes of key and seed; sides
    are cut to the tile's."""
    pick = lambda name: uniform(F.concat(key.cast("string"), F.lit(f"-{seed}-{name}")))
    area = (pick("area") * (scale[1] - scale[0]) + scale[0]) * (h * w)
    shape = F.exp(pick("ratio") * (np.log(ratio[1]) - np.log(ratio[0])) + np.log(ratio[0]))
    side = lambda v, most: F.least(F.greatest(F.round(v), F.lit(1.0)), F.lit(float(most)))
    part = F.struct(side(F.sqrt(area / shape), h).alias("h"), side(F.sqrt(area * shape), w).alias("w"))
    placed = lambda p: F.struct(p["h"].alias("h"), p["w"].alias("w"), F.floor(pick("y") * (F.lit(h + 1) - p["h"])).alias("y"), F.floor(pick("x") * (F.lit(w + 1) - p["w"])).alias("x"))
    chosen = F.transform(F.array(part), placed)

    def cell(p: Column, i: Column) -> Column:
        if label:
            y, x = F.floor(F.floor(i / ow) * p["h"] / oh), F.floor((i % ow) * p["w"] / ow)
            return F.get(tile, ((p["y"] + y) * w + p["x"] + x).cast("int")).cast("double")
        last = lambda v, size: F.least(F.greatest(v, F.lit(0.0)), size - 1)
        y, x = last((F.floor(i / ow) + 0.5) * p["h"] / oh - 0.5, p["h"]), last((i % ow + 0.5) * p["w"] / ow - 0.5, p["w"])
        at = lambda dy, dx: F.get(tile, ((p["y"] + F.least(F.floor(y) + dy, p["h"] - 1)) * w + p["x"] + F.least(F.floor(x) + dx, p["w"] - 1)).cast("int")).cast("double")
        fy, fx = y - F.floor(y), x - F.floor(x)
        return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy

    grid = F.sequence(F.lit(0), F.lit(oh * ow - 1))
    return F.when(tile.isNotNull(), F.get(F.transform(chosen, lambda p: F.transform(grid, lambda i: cell(p, i))), F.lit(0)))


# ---- rasters ---------------------------------------------------------------------------------------------------------

Mapping = Callable[[Column, Column], tuple[Column, Column]]


def warp(pixels: DataFrame, height: int, width: int, place: Mapping, *, method: str = "bilinear", size: int = 256) -> DataFrame:
    """(y, x, v) of a height x width raster drawn from pixels (y, x, v) of another: place gives, for columns y and x of the
    target, where the pixel's centre lies in the source (row, column, in pixel centres).

    nearest takes the source pixel whose cell holds the place (half goes up); bilinear weighs the up to four around it, and
    those that are missing or null are left out, the others' weights adding up to one. Target pixels without any source have
    no row. size: side of the source tiles; a group is one of them with its halo and the target pixels in it.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError("method has to be nearest or bilinear")
    spark = pixels.sparkSession
    rows = spark.range(height).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("x"))
    sy, sx = place(F.col("y"), F.col("x"))
    asked = rows.select("y", "x", sy.cast("double").alias("sy"), sx.cast("double").alias("sx"))
    half = 0.5 if method == "nearest" else 0.0
    asked = asked.withColumns({"ty": F.floor((F.floor(F.col("sy") + half)) / size), "tx": F.floor((F.floor(F.col("sx") + half)) / size)})
    # A pixel on a tile's upper or left side is also in the halo of the tile before; places just outside the raster use it too.
    near = lambda c: F.when(F.pmod(F.col(c), F.lit(size)) == 0, F.array(F.floor(F.col(c) / size), F.floor(F.col(c) / size) - 1)).otherwise(F.array(F.floor(F.col(c) / size)))
    source = pixels.where("v is not null").select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("double").alias("v"))
    source = source.select("*", F.explode(near("y")).alias("ty")).select("*", F.explode(near("x")).alias("tx"))

    def sample(key: tuple, targets: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        side = size + 1
        y0, x0 = int(key[0]) * size, int(key[1]) * size
        tile, known = np.zeros((side, side)), np.zeros((side, side), bool)
        at = own["y"].to_numpy() - y0, own["x"].to_numpy() - x0
        tile[at], known[at] = own["v"], True
        y, x = targets["sy"].to_numpy() - y0, targets["sx"].to_numpy() - x0
        places, weights = nearest_sources(y, x, side, side) if method == "nearest" else bilinear_sources(y, x, side, side)
        weights = np.where((places >= 0) & known.ravel()[np.maximum(places, 0)], weights, 0.0)
        total = weights.sum(1)
        some = total > 0
        value = (tile.ravel()[np.maximum(places, 0)] * weights).sum(1)[some] / total[some]
        return pd.DataFrame({"y": targets["y"].to_numpy()[some], "x": targets["x"].to_numpy()[some], "v": value})

    return asked.groupBy("ty", "tx").cogroup(source.groupBy("ty", "tx")).applyInPandas(sample, "y bigint, x bigint, v double")
