"""Components of a raster of any size, across the edges of tiles, and their polygons.

Each tile is labelled by itself, one bounded group. Labels that touch across a tile's edge are pairs of a graph, whose
components give every label its root; only tile sides meet in a join. Polygons come from corners: at each lattice point the
up to four pixels around it say which components turn there. Tiles send the corners inside them and what they know of the
points on their sides; the parts of a point are added up, and a component's corners are linked to rings. Work goes with
tiles, sides and corners, not with pixels; a polygon is one row, so its corners, not its pixels, have to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from . import tiles
from .graph import connected

#: A label is a pixel's row times this plus its column, of the first pixel of its component in row-major order.
ROW = 1 << 32
#: Bits of the pixels around a lattice point.
NW, NE, SW, SE = 1, 2, 4, 8
#: Points that no side turns at: within a component, or on a straight side.
_STRAIGHT = (0, NW | NE, SW | SE, NW | SW, NE | SE, NW | NE | SW | SE)


def tile_labels(pixels: DataFrame, size: int) -> DataFrame:
    """(ty, tx, labels) of each tile that has set pixels, of pixels (y, x, v) with y, x >= 0, set where v = 1: size * size
    labels in row-major order, 0 where no pixel is set. Repeated pixels count once; null values are not set."""

    def label(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((size, size), bool)
        mask[frame["y"] % size, frame["x"] % size] = True
        place = tiles.components(mask).astype(np.int64).ravel()
        first = np.maximum(place - 1, 0)
        own = (key[0] * size + first // size) * ROW + key[1] * size + first % size
        return pd.DataFrame({"ty": [key[0]], "tx": [key[1]], "labels": [np.where(place > 0, own + 1, 0)]})

    own = pixels.where("v = 1").select(F.expr(f"cast(y div {size} as bigint) as ty"), F.expr(f"cast(x div {size} as bigint) as tx"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    return own.groupBy("ty", "tx").applyInPandas(label, "ty bigint, tx bigint, labels array<bigint>")


def seams(labelled: DataFrame, size: int) -> DataFrame:
    """(a, b): labels of tiles that touch across a tile's right or lower side."""

    def side(first: int, step: int):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("labels", i * step + first))

    def pairs(one, two, dy: int, dx: int) -> DataFrame:
        ahead = labelled.select((F.col("ty") - dy).alias("ty"), (F.col("tx") - dx).alias("tx"), two.alias("two"))
        both = labelled.select("ty", "tx", one.alias("one")).join(ahead, ["ty", "tx"])
        met = both.select(F.explode(F.arrays_zip("one", "two")).alias("p")).select(F.col("p.one").alias("a"), F.col("p.two").alias("b"))
        return met.where("a > 0 and b > 0")

    right = pairs(side(size - 1, size), side(0, size), 0, 1)
    return right.unionAll(pairs(side((size - 1) * size, 1), side(0, 1), 1, 0)).distinct()


class Regions:
    """Labelled tiles of a raster and the roots of the labels that cross a tile's edge. Labels are one more than the place
    (row * 2**32 + column) of their first pixel; a component has the least label of its parts."""

    def __init__(self, pixels: DataFrame, size: int = 256):
        self.size = size
        self.labelled = stored(tile_labels(pixels, size), "labels")
        self.roots = stored(connected(seams(self.labelled, size)), "roots")

    def _rooted(self, df: DataFrame) -> DataFrame:
        """df with component in place of label."""
        roots = self.roots.select(F.col("id").alias("label"), "root")
        return df.join(roots, "label", "left").withColumn("component", F.coalesce("root", "label")).drop("label", "root")

    def pixels(self) -> DataFrame:
        """(y, x, component) of each set pixel."""
        cells = self.labelled.select("ty", "tx", F.posexplode("labels").alias("i", "label")).where("label > 0")
        at = cells.select("label", (F.col("ty") * self.size + F.expr(f"i div {self.size}")).alias("y"), (F.col("tx") * self.size + F.col("i") % self.size).alias("x"))
        return self._rooted(at).select("y", "x", "component")

    def stats(self) -> DataFrame:
        """(component, n, cx, cy): number of pixels and centre of each component; tiles send one row a label."""
        size = self.size

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for ty, tx, labels in zip(frame["ty"], frame["tx"], frame["labels"], strict=True):
                    at = np.flatnonzero(labels)
                    label, back = np.unique(np.asarray(labels)[at], return_inverse=True)
                    add = lambda v, back=back, n=len(label): np.bincount(back, v, n)
                    yield pd.DataFrame({"label": label, "n": np.bincount(back, minlength=len(label)), "sy": add(ty * size + at // size + 0.5), "sx": add(tx * size + at % size + 0.5)})

        own = self.labelled.mapInPandas(sums, "label bigint, n bigint, sy double, sx double")
        by = self._rooted(own).groupBy("component").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
        return by.select("component", "n", (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"))

    def corners(self) -> DataFrame:
        """(component, y, x, around): the lattice points where a component's border turns, and which of the four pixels around
        belong to it (bits NW, NE, SW, SE)."""
        size = self.size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for ty, tx, labels in zip(frame["ty"], frame["tx"], frame["labels"], strict=True):
                    label, y, x, around = tile_corners(np.asarray(labels).reshape(size, size))
                    yield pd.DataFrame({"label": label, "y": y + ty * size, "x": x + tx * size, "around": around})

        parts = self._rooted(self.labelled.mapInPandas(run, "label bigint, y bigint, x bigint, around int"))
        whole = parts.groupBy("component", "y", "x").agg(F.bit_or("around").alias("around"))
        return whole.where(~F.col("around").isin(*_STRAIGHT))

    def polygons(self) -> DataFrame:
        """(component, rings): the border of each component in pixel corners. Rings are closed and have only corners; the first
        goes round the component, the others round its holes, the other way."""

        def linked(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
            rings = link(frame["y"].to_numpy(), frame["x"].to_numpy(), frame["around"].to_numpy())
            return pd.DataFrame({"component": [key[0]], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings]]})

        return self.corners().groupBy("component").applyInPandas(linked, "component bigint, rings array<array<struct<x: bigint, y: bigint>>>")


def tile_corners(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label, y, x, around) at the lattice points of a tile: inside it where a label's border turns, on its sides wherever a
    label is."""
    size = len(labels)
    wide = np.pad(labels, 1)
    four = np.stack([wide[:-1, :-1], wide[:-1, 1:], wide[1:, :-1], wide[1:, 1:]])
    y, x = np.mgrid[: size + 1, : size + 1]
    side = (y == 0) | (y == size) | (x == 0) | (x == size)
    out = []
    for q in range(4):
        own = four[q]
        around = sum(((four[r] == own) << r for r in range(4)), np.zeros(own.shape, np.int64))
        first = own > 0
        for r in range(q):
            first &= four[r] != own
        keep = first & (side | ~np.isin(around, _STRAIGHT))
        out.append((own[keep], y[keep], x[keep], around[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def link(y: np.ndarray, x: np.ndarray, around: np.ndarray) -> list[list[tuple[int, int]]]:
    """The closed rings (x, y) of one component from its corners. Rings go with the component on their right, so that the
    outer one has a positive shoelace sum with y downwards; where two pixels touch at a corner only, a ring turns right, which
    keeps it round the same pixel."""
    n = len(y)
    rows, columns = np.lexsort((x, y)), np.lexsort((y, x))
    to_right, to_left, to_low, to_top = (np.full(n, -1) for _ in range(4))
    to_right[rows[:-1]], to_left[rows[1:]] = rows[1:], rows[:-1]
    to_low[columns[:-1]], to_top[columns[1:]] = columns[1:], columns[:-1]
    bit = lambda b: (around & b) > 0
    east, west, south, north = bit(NE) ^ bit(SE), bit(NW) ^ bit(SW), bit(SW) ^ bit(SE), bit(NW) ^ bit(NE)
    # Headings 0 to 3 are right, down, left and up; from each the right turn comes first.
    step = (to_right.tolist(), to_low.tolist(), to_left.tolist(), to_top.tolist())
    leaves = (east.tolist(), south.tolist(), west.tolist(), north.tolist())
    open_ = set(np.flatnonzero(east & bit(SE)).tolist())
    rings = []
    for start in rows.tolist():
        if start not in open_:
            continue
        ring, at, heading = [], start, 0
        while True:
            if heading == 0:
                if at not in open_:
                    break
                open_.discard(at)
            ring.append((int(x[at]), int(y[at])))
            at = step[heading][at]
            right = (heading + 1) % 4
            heading = right if leaves[right][at] else (heading + 3) % 4
        rings.append([*ring, ring[0]])
    turned = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r[:-1], r[1:], strict=True)) for r in rings]
    return [r for _, r in sorted(zip([t < 0 for t in turned], rings, strict=True), key=lambda p: p[0])]
