"""Operators on tiles held as arrays: index maps as higher-order functions, and NumPy kernels in Arrow batches.

A tile is an array of h * w (* bands, band-major) numbers; element y * w + x of a band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def remap(tile: Column, n: int, source: Callable[[Column], Column]) -> Column:
    """A tile of n elements whose element i is element source(i) of the old one."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(tile, source(i).cast("int")))


def _y(i: Column, w: int) -> Column:
    return F.floor(i / w)


def flip_h(tile: Column, h: int, w: int) -> Column:
    return remap(tile, h * w, lambda i: _y(i, w) * w + (w - 1 - i % w))


def flip_v(tile: Column, h: int, w: int) -> Column:
    return remap(tile, h * w, lambda i: (h - 1 - _y(i, w)) * w + i % w)


def crop(tile: Column, h: int, w: int, y0: int | Column, x0: int | Column, ch: int, cw: int) -> Column:
    return remap(tile, ch * cw, lambda i: (_y(i, cw) + y0) * w + i % cw + x0)


def random_crop(tile: Column, h: int, w: int, ch: int, cw: int, key: Column, seed: int) -> Column:
    """A ch x cw part at a place that a hash of key and seed chooses."""
    from .selection import uniform

    at = lambda axis, room: F.floor(uniform(F.concat(key.cast("string"), F.lit(f"-{seed}-{axis}"))) * room)
    return crop(tile, h, w, at("y", h - ch + 1), at("x", w - cw + 1), ch, cw)


def pad_if_smaller(tile: Column, h: int, w: int, size: int, fill: float = 0.0) -> Column:
    """The tile with fill to the right and below, up to size x size; sides that are long enough stay."""
    oh, ow = max(h, size), max(w, size)
    inside = lambda i: (_y(i, ow) < h) & (i % ow < w)
    return F.transform(F.sequence(F.lit(0), F.lit(oh * ow - 1)), lambda i: F.when(inside(i), F.get(tile, (_y(i, ow) * w + i % ow).cast("int"))).otherwise(F.lit(fill)))


def random_apply(tile: Column, change: Callable[[Column], Column], key: Column, seed: int, chance: float = 0.5) -> Column:
    """change of the tiles for which a hash of key and seed falls below chance. Calls compose one after another."""
    from .selection import uniform

    return F.when(uniform(F.concat(key.cast("string"), F.lit(f"-{seed}"))) < chance, change(tile)).otherwise(tile)


def center_crop(tile: Column, h: int, w: int, ch: int, cw: int) -> Column:
    return crop(tile, h, w, round((h - ch) / 2), round((w - cw) / 2), ch, cw)


def _mirror(i: Column, n: int) -> Column:
    """Index reflected at 0 and n - 1 without repeating the edge."""
    a = F.abs(i)
    return F.when(a > n - 1, 2 * (n - 1) - a).otherwise(a)


def reflect_pad(tile: Column, h: int, w: int, top: int, left: int, bottom: int, right: int) -> Column:
    oh, ow = h + top + bottom, w + left + right
    return remap(tile, oh * ow, lambda i: _mirror(_y(i, ow) - top, h) * w + _mirror(i % ow - left, w))


def resample_nearest(tile: Column, h: int, w: int, oh: int, ow: int) -> Column:
    return remap(tile, oh * ow, lambda i: F.floor(_y(i, ow) * h / oh) * w + F.floor((i % ow) * w / ow))


def band(tile: Column, k: int, size: int) -> Column:
    return F.slice(tile, k * size + 1, size)


def normalize(tile: Column, mean: float, std: float) -> Column:
    return F.transform(tile, lambda x: (x.cast("double") - mean) / std)


def random_pixels(tile: Column, key: Column, ratio: float, value: float, seed: int) -> Column:
    """Pixels replaced by value where a hash of tile key, seed and position falls below ratio."""
    from .selection import uniform

    return F.transform(tile, lambda x, i: F.when(uniform(F.concat(key.cast("string"), F.lit(f"-{seed}-"), i.cast("string"))) < ratio, F.lit(value)).otherwise(x))


def exg(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def exgr(r: Column, g: Column, b: Column) -> Column:
    return 3 * g - 2.4 * r - b


def vdvi(r: Column, g: Column, b: Column) -> Column:
    return 2 * (2 * g - r - b) / (2 * g + r + b + 1e-8)


def veg_index(tile: Column, size: int, formula: Callable[[Column, Column, Column], Column]) -> Column:
    """A vegetation index of the first three bands, on values times 255."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: formula(*[F.get(tile, (i + k * size).cast("int")).cast("double") * 255 for k in range(3)]))


# ---- NumPy kernels -------------------------------------------------------------------------------------------------


def map_tiles(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], h: int, w: int, *, tile: str = "embedding", out: str = "tile") -> DataFrame:
    """df with a column out: kernel of each h x w tile, flattened (doubles). Null tiles stay null."""
    kept = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[kept].assign(**{out: [None if t is None else kernel(np.asarray(t, np.float64).reshape(h, w)).ravel().tolist() for t in frame[tile]]})

    return df.mapInPandas(run, f"{schema}, `{out}` array<double>")


def bilinear(tile: np.ndarray, oh: int, ow: int) -> np.ndarray:
    """Plain bilinear resampling with half-pixel centres, edges clamped."""
    h, w = tile.shape
    y = np.clip((np.arange(oh) + 0.5) * h / oh - 0.5, 0, h - 1)
    x = np.clip((np.arange(ow) + 0.5) * w / ow - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = tile[np.ix_(y0, x0)] * (1 - fx) + tile[np.ix_(y0, x1)] * fx
    low = tile[np.ix_(y1, x0)] * (1 - fx) + tile[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def rotate(tile: np.ndarray, degrees: float, fill: float = 0.0) -> np.ndarray:
    """Nearest rotation about the centre, counter-clockwise; outside is fill."""
    h, w = tile.shape
    cy, cx, a = (h - 1) / 2, (w - 1) / 2, np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w]
    sy = np.rint(cy + (y - cy) * np.cos(a) + (x - cx) * np.sin(a)).astype(int)
    sx = np.rint(cx - (y - cy) * np.sin(a) + (x - cx) * np.cos(a)).astype(int)
    ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(ok, tile[sy.clip(0, h - 1), sx.clip(0, w - 1)], fill)


def jitter(tile: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    """Brightness, then contrast about the mean, clipped to [0, 1]."""
    out = np.clip(tile * brightness, 0, 1)
    return np.clip((out - out.mean()) * contrast + out.mean(), 0, 1)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set pixel to the nearest unset one (squared lower envelopes, rows then columns)."""
    far = float(sum(mask.shape) ** 2)
    out = np.where(mask, far, 0.0)
    for axis in (0, 1):
        n = out.shape[axis]
        gap = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        rows = np.moveaxis(out, axis, 0).reshape(n, -1)
        best = np.array([(rows + gap[k][:, None]).min(0) for k in range(n)])
        out = np.moveaxis(best.reshape((n, *np.delete(out.shape, axis))), 0, axis)
    return np.sqrt(out)


def components(mask: np.ndarray) -> np.ndarray:
    """4-neighbour components, each labelled by its smallest row-major position plus one; 0 outside.

    Runs of set pixels are joined with the runs of the row above that they touch; the work goes with the number of runs.
    """
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    change = np.diff(wide, axis=1)
    starts, stops = np.flatnonzero(change[:, :w].ravel() == 1), np.argwhere(change == -1) @ [w, 1]
    # of each run the runs above that share a column with it
    low, high = np.searchsorted(stops, starts - w, "right"), np.searchsorted(starts, stops - w, "left")
    root = list(range(len(starts)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in np.flatnonzero(high > low).tolist():
        for j in range(low[k], high[k]):
            a, b = find(k), find(j)
            root[max(a, b)] = min(a, b)
    out = np.zeros(h * w, np.int64)
    label = np.array([starts[find(k)] + 1 for k in range(len(starts))], np.int64)
    sizes = stops - starts
    out[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = np.repeat(label, sizes)
    return out.reshape(h, w)


def local_peaks(distance: np.ndarray, labels: np.ndarray, min_distance: int, footprint: np.ndarray | None = None, border: int = 0) -> list[tuple[int, int]]:
    """Maxima of the distance inside each labelled region, the highest first, none within min_distance of a better one of its
    region. footprint: the neighbourhood (odd sides, centred) in which a peak has to be a maximum; without one, the square of
    side 2 min_distance + 1. border: no peak lies within so many pixels of the tile's sides; peak searches that leave out what
    may be higher outside have it at min_distance.

    Regions don't see each other: values outside a region count as lower than all of its own. A mask is one label for all of
    the foreground; label the components first if each of them is to have a peak.
    """
    shape = footprint.shape if footprint is not None else (2 * min_distance + 1,) * 2
    foot = footprint.astype(bool) if footprint is not None else np.ones(shape, bool)
    near = np.argwhere(foot) - np.array(shape) // 2
    h, w = distance.shape
    labels = labels.astype(np.int64)
    taken, out = np.zeros(distance.shape, bool), []
    for at in np.lexsort((np.arange(distance.size), -distance.ravel())):
        y, x = divmod(int(at), w)
        if not labels[y, x] or distance[y, x] <= 0 or not (border <= y < h - border and border <= x < w - border):
            continue
        ny, nx = (near + [y, x]).T
        ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
        ny, nx = ny[ok], nx[ok]
        own = labels[ny, nx] == labels[y, x]
        window = (slice(max(0, y - min_distance), y + min_distance + 1), slice(max(0, x - min_distance), x + min_distance + 1))
        if distance[y, x] >= distance[ny[own], nx[own]].max(initial=0) and not (taken[window] & (labels[window] == labels[y, x])).any():
            taken[y, x] = True
            out.append((y, x))
    return out


def watershed(mask: np.ndarray, min_distance: int = 1, min_size: int = 1, footprint: np.ndarray | None = None, border: int = 0) -> np.ndarray:
    """Crowns of a binary tile: flood from the peaks of the distance transform, highest first; small crowns are dropped.

    The peak search gets the mask as its labels, which is one region for all of the foreground: a peak may suppress a lower
    one of another component within min_distance. Such a component has no marker and is in no crown. border as for the peaks: crowns whose
    only peaks are that near to a side are left out.
    """
    import heapq

    distance = distance_transform(mask)
    label = np.zeros(mask.shape, np.int64)
    heap = []
    for k, (y, x) in enumerate(local_peaks(distance, mask, min_distance, footprint, border), 1):
        label[y, x] = k
        heapq.heappush(heap, (-distance[y, x], k, y, x))
    while heap:
        _, k, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not label[ny, nx]:
                label[ny, nx] = k
                heapq.heappush(heap, (-distance[ny, nx], k, ny, nx))
    size = np.bincount(label.ravel())
    return np.where(size[label] >= min_size, label, 0)


def polygon_mask(ring: list[tuple[float, float]], h: int, w: int) -> np.ndarray:
    """Pixels whose centre is inside the ring (even-odd ray casting)."""
    y, x = np.mgrid[:h, :w] + 0.5
    inside = np.zeros((h, w), bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            cross = (y0 > y) != (y1 > y)
            inside ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def equalize(tile: np.ndarray, levels: int = 256, limit: float | None = None) -> np.ndarray:
    """Histogram equalisation of values in [0, 1]; with limit, bins above limit times the mean share their excess."""
    q = np.clip(np.rint(tile * (levels - 1)), 0, levels - 1).astype(int)
    hist = np.bincount(q.ravel(), minlength=levels).astype(float)
    if limit:
        top = limit * hist.mean()
        hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / levels
    cdf = np.cumsum(hist)
    low = cdf[cdf > 0].min(initial=0)
    span = cdf[-1] - low
    return (np.rint((cdf - low) / span * (levels - 1)).clip(0, levels - 1) if span > 0 else np.arange(levels))[q] / (levels - 1)
