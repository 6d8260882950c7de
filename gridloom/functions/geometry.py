"""Closed-form geometry, georeference and clock functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def apply_affine(gt: tuple[float, ...], col: Column, row: Column) -> tuple[Column, Column]:
    """Map coordinates of pixel coordinates; gt is (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = gt
    x = F.lit(c) + col * a if b == 0 else F.lit(c) + col * a + row * b
    y = F.lit(f) + row * e if d == 0 else F.lit(f) + col * d + row * e
    return x, y


def metres_to_degrees(dx: Column, dy: Column, latitude: Column) -> tuple[Column, Column]:
    return dx / (111320.0 * F.cos(F.radians(F.abs(latitude)))), dy / 110540.0


def degrees_to_metres(dx: Column, dy: Column, latitude: Column) -> tuple[Column, Column]:
    return dx * (111320.0 * F.cos(F.radians(F.abs(latitude)))), dy * 110540.0


def rotated_rect(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Sides of the largest axis-aligned rectangle in a w x h rectangle turned by angle (radians)."""
    sin, cos = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    long_side, short = F.greatest(w, h), F.least(w, h)
    half = (short <= 2 * sin * cos * long_side) | (F.abs(sin - cos) < 1e-10)
    safe = lambda x: F.when(x == 0, F.lit(1e-300)).otherwise(x)
    double = safe(cos * cos - sin * sin)
    touch = 0.5 * short
    wr = F.when(half, F.when(w >= h, touch / safe(sin)).otherwise(touch / safe(cos))).otherwise((w * cos - h * sin) / double)
    hr = F.when(half, F.when(w >= h, touch / safe(cos)).otherwise(touch / safe(sin))).otherwise((h * cos - w * sin) / double)
    return wr, hr


def seconds_until(ts: Column, start_hour: int, end_hour: int) -> Column:
    """Seconds until the daily window [start, end), which may pass midnight; 0 inside it."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    a, b = start_hour * 3600, end_hour * 3600
    inside = (second >= a) & (second < b) if a < b else (second >= a) | (second < b)
    return F.when(inside, 0).otherwise(F.pmod(a - second, F.lit(86400))).cast("bigint")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * r


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring, by the parity of the edges to its right."""
    crossed = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            hit = ((y < y0) != (y < y1)) & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0)
            crossed = crossed + hit.cast("int")
    return crossed % 2 == 1


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.pi() / 2)


def index_of(gt: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel coordinates (column, row) of map coordinates, the inverse of apply_affine()."""
    a, b, c, d, e, f = gt
    det = a * e - b * d
    dx, dy = x - c, y - f
    return (dx * e - dy * b) / det, (dy * a - dx * d) / det


def sphere_area(ring: Column, radius: float = 6371008.8) -> Column:
    """The area of a closed ring of (x, y) in degrees on a sphere, its sides being great circles, in square units of radius: the
    smaller of the two parts that the ring makes.

    Each side adds the spherical excess of the triangle between it and the equator; a ring round a pole misses half a sphere,
    which shows in the sum of its turns in longitude."""
    half = lambda v: F.tan(F.radians(v) / 2)

    def side(p: Column, q: Column) -> Column:
        turn = F.pmod(q["x"] - p["x"] + 180.0, F.lit(360.0)) - 180.0
        return F.struct((2 * F.atan2(half(turn) * (half(p["y"]) + half(q["y"])), 1 + half(p["y"]) * half(q["y"]))).alias("e"), turn.alias("t"))

    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), side)
    sums = F.aggregate(sides, F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("t")), lambda s, v: F.struct((s["e"] + v["e"]).alias("e"), (s["t"] + v["t"]).alias("t")))
    excess = F.abs(sums["e"])
    whole = F.when(F.abs(sums["t"]) > 180.0, F.abs(2 * F.pi() - excess)).otherwise(excess)
    return F.least(whole, 4 * F.pi() - whole) * radius**2
