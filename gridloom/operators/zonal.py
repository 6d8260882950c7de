"""Pixel and centroid aggregates on coarse grids, overlays of overlapping predictions, pyramids and rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored


def cell_of(x: str, size: float) -> Column:
    return F.floor(F.col(x) / size).cast("bigint")


def density_bands(crowns: DataFrame, resolution: float, limits: list[float]) -> DataFrame:
    """Per cell of ``resolution`` metres: 10000 / resolution^2 for each centroid; band 1 all, then by area class.

    Areas below the first limit count in band 1 only; the last class is open.
    """
    unit = 10000.0 / resolution**2
    bands = [F.count("*") * unit]
    for low, high in zip(limits, [*limits[1:], None], strict=True):
        inside = F.col("area") >= low
        bands.append(F.sum((inside if high is None else inside & (F.col("area") < high)).cast("int")) * unit)
    return crowns.groupBy(cell_of("cx", resolution).alias("gx"), cell_of("cy", resolution).alias("gy")).agg(*[b.cast("double").alias(f"band{k}") for k, b in enumerate(bands, 1)])


def canopy_cover(pixels: DataFrame, factor: int, nodata: int = 255) -> DataFrame:
    """Percentage of set pixels among those with data, per factor x factor cell; null where all are nodata."""
    value = F.when(F.col("v") != nodata, F.col("v").cast("double"))
    return pixels.groupBy(cell_of("x", factor).alias("gx"), cell_of("y", factor).alias("gy")).agg((100 * F.avg(value)).alias("cover"))


OVERLAYS = ("MIN", "MAX", "MEAN", "REPLACE")


def overlay(values: DataFrame, keys: list[str], mode: str, *, value: str = "v", order: str = "seq") -> DataFrame:
    """Merge overlapping predictions per pixel: MIN, MAX, the running pairwise MEAN from 0, or the last in order.

    A missing prediction (null or NaN) is skipped, but by REPLACE, which takes the last one as it is; MIN and MAX of missing
    ones alone are null, their MEAN is the 0 that it begins with.
    """
    known = F.col(value) if dict(values.dtypes)[value] not in ("float", "double") else F.when(~F.isnan(value), F.col(value))
    if mode == "MAX":
        merged = F.max(known)
    elif mode == "MIN":
        merged = F.min(known)
    elif mode == "REPLACE":
        merged = F.max_by(value, order)
    elif mode == "MEAN":
        items = F.array_sort(F.collect_list(F.when(known.isNotNull(), F.struct(order, value))))
        merged = F.aggregate(items, F.lit(0.0), lambda acc, e: (acc + e[value].cast("double")) / 2)
    else:
        raise ValueError(f"overlay must be one of {OVERLAYS}")
    return values.groupBy(*keys).agg(merged.alias(value))


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """Overviews (level, oy, ox, v) by powers of two with nearest resampling: each cell takes its upper left pixel that exists.
    A level is made from the one before, which is stored, so that all together read little more than the pixels once."""
    own = pixels.select(F.struct(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).alias("_at"), "v")
    out = None
    for level in range(1, levels + 1):
        cell = [F.expr(f"_at.{a} div {1 << level}").cast("bigint").alias(f"o{a}") for a in ("y", "x")]
        own = stored(own.groupBy(*cell).agg(F.min("_at").alias("_at"), F.min_by("v", "_at").alias("v")).select("_at", "v", "oy", "ox"), f"level{level}")
        rows = own.select(F.lit(level).cast("bigint").alias("level"), "oy", "ox", "v")
        out = rows if out is None else out.unionAll(rows)
    return out


def rescale(pixels: DataFrame, low: float, high: float, out_low: float, out_high: float) -> Column:
    """v from [low, high] to [out_low, out_high], rounded and clipped."""
    x = (F.col("v") - low) / (high - low) * (out_high - out_low) + out_low
    return F.greatest(F.lit(out_low), F.least(F.lit(out_high), F.round(x)))


def band_stats(pixels: DataFrame, band: str, value: str, nodata: float) -> DataFrame:
    """Mean and population standard deviation per band, without nodata."""
    v = F.when(F.col(value) != nodata, F.col(value).cast("double"))
    return pixels.groupBy(band).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def zscore(pixels: DataFrame, group: list[str], value: str) -> Column:
    """(v - mean) / (population std + 1e-8) within the group."""
    w = Window.partitionBy(*group)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8)


def masked_prediction(pixels: DataFrame, validity: DataFrame, *, threshold: float = 0.5, nodata: int = 255) -> DataFrame:
    """(y, x, v) of a prediction to be written: 1 where prob of pixels (y, x, prob) is above threshold, else 0, and nodata
    where validity (y, x, valid) does not hold the pixel or says that it is not valid."""
    valid = validity.select("y", "x", F.col("valid").cast("boolean").alias("valid"))
    value = F.when(~F.coalesce("valid", F.lit(False)), nodata).when(F.col("prob") > threshold, 1).otherwise(0)
    return pixels.join(valid, ["y", "x"], "left").select("y", "x", value.alias("v"))


def average_to_bounds(pixels: DataFrame, bounds: tuple[float, float, float, float], resolution: float, nodata: int = 255) -> DataFrame:
    """(gy, gx, v): the mean of the pixels with data (y, x, v) in each cell of a grid that begins at the first two of bounds
    (x0, y0, x1, y1) and has whole cells up to the others; null where a cell has no data."""
    x0, y0, x1, y1 = bounds
    inside = pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    at = lambda c, zero: F.floor((F.col(c) - zero) / resolution).cast("bigint")
    value = F.when(F.col("v") != nodata, F.col("v").cast("double"))
    return inside.groupBy(at("y", y0).alias("gy"), at("x", x0).alias("gx")).agg(F.avg(value).alias("v"))


def translate(pixels: DataFrame, window: tuple[int, int, int, int], ring: list[tuple[float, float]] | None = None, nodata: int = 255) -> DataFrame:
    """A copy of pixels (y, x, v) in window (y0, x0, y1, x1), with its corner as origin; pixels whose centre is outside ring
    (map coordinates of the source) take nodata."""
    from ..functions.geometry import in_ring

    y0, x0, y1, x1 = window
    own = pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    value = F.col("v") if ring is None else F.when(in_ring(F.col("x") + 0.5, F.col("y") + 0.5, ring), F.col("v")).otherwise(nodata)
    return own.select((F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), value.alias("v"))
