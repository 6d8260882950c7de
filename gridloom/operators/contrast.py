"""Contrast of image tiles: histogram equalisation with a limit, by parts of a tile, on the lightness of colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEVELS = 256
#: Linear sRGB to XYZ under daylight (D65), and its white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
#: RGB to the luma and chroma of analogue video.
_YUV = np.array([[0.299, 0.587, 0.114], [-0.14713, -0.28886, 0.436], [0.615, -0.51499, -0.10001]])


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    """Lightness (0 to 100) and the two colour axes of sRGB values in [0, 1]; colours are on the last axis."""
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    """The other way, cut to [0, 1]."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f > 0.20689, f**3, (f - 16 / 116) / 7.787)
    linear = np.clip((t * _WHITE) @ np.linalg.inv(_XYZ).T, 0, None)
    return np.clip(np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear), 0, 1)


def rgb_to_yuv(rgb: np.ndarray) -> np.ndarray:
    return rgb @ _YUV.T


def yuv_to_rgb(yuv: np.ndarray) -> np.ndarray:
    return np.clip(yuv @ np.linalg.inv(_YUV).T, 0, 1)


def clipped_map(values: np.ndarray, limit: float) -> np.ndarray:
    """The new level of each of LEVELS levels, by the cumulated counts of values. No level counts more than limit times the
    mean count (one at least); what is over is given to all levels alike, and the rest of it to levels in even steps. A limit
    of 0 clips nothing."""
    counts = np.bincount(values.ravel(), minlength=LEVELS).astype(np.int64)
    if limit > 0:
        top = max(int(limit * values.size / LEVELS), 1)
        over = int(np.maximum(counts - top, 0).sum())
        counts = np.minimum(counts, top) + over // LEVELS
        if rest := over % LEVELS:
            counts[:: max(LEVELS // rest, 1)][:rest] += 1
    return np.clip(np.rint(np.cumsum(counts) * ((LEVELS - 1) / values.size)), 0, LEVELS - 1)


def clahe(values: np.ndarray, grid: tuple[int, int], limit: float) -> np.ndarray:
    """Levels (0 to 255) of a tile after equalisation by the parts of a grid (rows, columns). Each part has a map of its own; a
    pixel takes the maps of the four parts whose middles are around it, weighted by distance. Sides that the grid doesn't
    divide are mirrored up to the next multiple."""
    h, w = values.shape
    gy, gx = grid
    wide = np.pad(values, ((0, -h % gy), (0, -w % gx)), "reflect" if min(h, w) > 1 else "edge") if h % gy or w % gx else values
    ph, pw = wide.shape[0] // gy, wide.shape[1] // gx
    maps = np.array([[clipped_map(wide[j * ph : (j + 1) * ph, i * pw : (i + 1) * pw], limit) for i in range(gx)] for j in range(gy)])
    fy, fx = np.arange(h) / ph - 0.5, np.arange(w) / pw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda dy, dx: maps[np.clip(y0 + dy, 0, gy - 1)[:, None], np.clip(x0 + dx, 0, gx - 1)[None], values]
    return np.rint((at(0, 0) * (1 - wx) + at(0, 1) * wx) * (1 - wy) + (at(1, 0) * (1 - wx) + at(1, 1) * wx) * wy)


def _on_first(rgb: np.ndarray, change, there, back, top: float) -> np.ndarray:
    """Colours (bands, h, w) whose first axis after there() is changed in LEVELS steps of its range up to top."""
    own = there(np.moveaxis(rgb, 0, -1))
    level = np.clip(np.rint(own[..., 0] / top * (LEVELS - 1)), 0, LEVELS - 1).astype(int)
    own[..., 0] = change(level) / (LEVELS - 1) * top
    return np.moveaxis(back(own), -1, 0)


def clahe_rgb(tile: np.ndarray, grid: tuple[int, int] = (4, 4), limit: float = 1.0) -> np.ndarray:
    """clahe() of the lightness of the first three bands (0 to 1) of a tile (bands, h, w); colours and other bands stay."""
    out = tile.astype(np.float64).copy()
    out[:3] = _on_first(np.clip(out[:3], 0, 1), lambda v: clahe(v, grid, limit), rgb_to_lab, lab_to_rgb, 100.0)
    return out


def equalize_rgb(tile: np.ndarray) -> np.ndarray:
    """Plain equalisation of the luma of the first three bands (0 to 1) of a tile (bands, h, w); the least level that is
    met becomes 0."""

    def change(v: np.ndarray) -> np.ndarray:
        counts = np.bincount(v.ravel(), minlength=LEVELS)
        low = counts[np.flatnonzero(counts)[0]]
        return v if low == v.size else np.rint((np.cumsum(counts) - low) * ((LEVELS - 1) / (v.size - low)))[v]

    out = tile.astype(np.float64).copy()
    out[:3] = _on_first(np.clip(out[:3], 0, 1), change, rgb_to_yuv, yuv_to_rgb, 1.0)
    return out


def map_bands(df: DataFrame, kernel, bands: int, h: int, w: int, *, tile: str = "tile", out: str = "tile") -> DataFrame:
    """df with out: kernel of each tile as an array (bands, h, w), flattened; in batches, as flat arrays. Null tiles stay
    null."""
    kept = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[kept].assign(**{out: [None if t is None else kernel(np.asarray(t, np.float64).reshape(bands, h, w)).ravel() for t in frame[tile]]})

    return df.mapInPandas(run, f"{schema}, `{out}` array<double>")
