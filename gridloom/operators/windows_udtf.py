"""A table function from windows to polygons, for SQL: one row of pixels in, a row for each component out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, LongType, StructType

from .regions import _STRAIGHT, link, tile_corners
from .tiles import components


@dataclass
class WindowAnalysis(AnalyzeResult):
    """What a call said: the names of the columns and the threshold."""

    key: str = ""
    tile: str = ""
    threshold: float = 0.0


class WindowPolygons:
    """window_polygons(table(windows), key => name, tile => name, threshold => number): of each row's square tile (an array of
    n * n numbers) the 4-neighbour components of pixels above threshold, as rows (key, label, area, rings) in pixel corners.

    label is the smallest row-major position of the component, from 1. Rows are dealt by key; a null tile, and one without
    pixels above the threshold, has no rows; a tile that is not square is an error.
    """

    def __init__(self, analysed: WindowAnalysis):
        self.key, self.tile, self.threshold = analysed.key, analysed.tile, analysed.threshold

    @staticmethod
    def analyze(windows: AnalyzeArgument, key: AnalyzeArgument, tile: AnalyzeArgument, threshold: AnalyzeArgument) -> WindowAnalysis:
        fields = {f.name: f for f in windows.dataType.fields}
        for name in (key.value, tile.value):
            if name not in fields:
                raise ValueError(f"the table has no column {name}")
        point = StructType().add("x", LongType()).add("y", LongType())
        schema = StructType().add(key.value, fields[key.value].dataType).add("label", LongType()).add("area", LongType()).add("rings", ArrayType(ArrayType(point)))
        return WindowAnalysis(schema, partitionBy=[PartitioningColumn(key.value)], key=key.value, tile=tile.value, threshold=float(threshold.value))

    def eval(self, windows: Row, key: str, tile: str, threshold: float) -> Iterator[tuple]:
        values = windows[self.tile]
        if values is None:
            return
        side = round(len(values) ** 0.5)
        labels = components(np.array(values, np.float64).reshape(side, side) > self.threshold)
        label, y, x, around = tile_corners(labels)
        for one, n in zip(*np.unique(labels[labels > 0], return_counts=True), strict=True):
            own = (label == one) & ~np.isin(around, _STRAIGHT)
            rings = link(y[own], x[own], around[own])
            yield windows[self.key], int(one), int(n), [[{"x": a, "y": b} for a, b in ring] for ring in rings]


def register(spark: SparkSession, name: str = "window_polygons") -> None:
    """Make the table function known to SQL under name."""
    spark.udtf.register(name, udtf(WindowPolygons))
