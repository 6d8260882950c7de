"""From regions to a mosaic: grid, read, predict, stitch; and from a mask to density and cover maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import mosaic, zonal
from ..operators.regions import Regions

#: A predictor takes tiles (n, bands, h, w) in [0, 1] and gives foreground probabilities (n, h, w), or, for the mode argmax,
#: a score of each class (n, classes, h, w).
Predictor = Callable[[np.ndarray], np.ndarray]

#: How masks come from what a predictor gives.
MODES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"sigmoid": lambda p: p > 0.5, "ensemble": lambda p: p >= 0.5, "argmax": lambda p: p.argmax(1)}


def excess_green(batch: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """A predictor without weights: excess green above a threshold."""
    return (2 * batch[:, 1] - batch[:, 0] - batch[:, 2] > threshold).astype(np.float64)


def predict(tiles: DataFrame, make: Callable[[], Predictor], h: int, w: int, bands: int, *, key: str = "tile_id", data: str = "data", scale: float = 255.0, mode: str = "sigmoid", batch: int = 150) -> DataFrame:
    """(key, tile: array<double>): the mask of each tile. make builds the predictor once per task.

    mode: sigmoid keeps probabilities strictly above 0.5, ensemble from 0.5 on (both give 0 and 1); argmax takes the class of
    the greatest score, the first of equals.
    """
    if mode not in MODES:
        raise ValueError(f"mode has to be one of {tuple(MODES)}")
    decide = MODES[mode]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for s in range(0, len(frame), batch):
                part = frame.iloc[s : s + batch]
                prob = model(np.array(part[data].tolist(), np.float64).reshape(-1, bands, h, w) / scale)
                mask = decide(prob)
                yield pd.DataFrame({key: part[key].to_numpy(), "tile": [m.ravel().astype(float).tolist() for m in mask]})

    return tiles.select(key, data).mapInPandas(run, f"{key} bigint, tile array<double>")


def mosaic_mask(tiles: DataFrame, grid: DataFrame, make: Callable[[], Predictor], patch: int, pad: int, height: int, width: int, bands: int) -> DataFrame:
    """(y, x, v) of the stitched prediction; grid gives each tile_id its place (gy, gx)."""
    masks = predict(tiles, make, patch, patch, bands).join(grid.select("tile_id", "gy", "gx"), "tile_id")
    return mosaic.stitch(masks, patch, pad, height, width)


def map_products(mask: DataFrame, tile: int, pixel: float, resolution: float, limits: list[float]) -> tuple[DataFrame, DataFrame]:
    """Density bands by crown area and the cover percentage of a mask (y, x, v), each one plan. Crowns are whole components,
    across the edges of the tiles that they are labelled in."""
    found = Regions(mask.withColumn("v", F.col("v").cast("int")), tile).stats()
    crowns = found.select((F.col("cx") * pixel).alias("cx"), (F.col("cy") * pixel).alias("cy"), (F.col("n") * pixel**2).alias("area"))
    return zonal.density_bands(crowns, resolution, limits), zonal.canopy_cover(mask, int(resolution / pixel))
