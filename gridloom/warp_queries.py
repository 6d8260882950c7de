"""Queries that resample tiles and rasters, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .functions import geometry
from .operators import warps
from .queries import query, r9


def _tile(tiles, value, digits: int = 6):
    return tiles.select("vec_id", F.transform(value, lambda v: F.round(v, digits)).alias("tile"))


_AT = "cast(embedding[cast({} as bigint) + 1] as double)"


@query(f"""select vec_id, list_transform(list_transform(range(144), lambda k: {{
    'y': greatest(0.0e0, least(7.0e0, (k // 12 + 0.5e0) * 8 / 12 - 0.5e0)), 'x': greatest(0.0e0, least(7.0e0, (k % 12 + 0.5e0) * 8 / 12 - 0.5e0))}}),
  lambda p: round(
    ({_AT.format('floor(p.y) * 8 + floor(p.x)')} * (1 - p.x + floor(p.x)) + {_AT.format('floor(p.y) * 8 + least(floor(p.x) + 1, 7)')} * (p.x - floor(p.x))) * (1 - p.y + floor(p.y))
    + ({_AT.format('least(floor(p.y) + 1, 7) * 8 + floor(p.x)')} * (1 - p.x + floor(p.x)) + {_AT.format('least(floor(p.y) + 1, 7) * 8 + least(floor(p.x) + 1, 7)')} * (p.x - floor(p.x))) * (p.y - floor(p.y)), 6) + 0.0e0) as tile
from tiles""", "tiles")
def resample_bilinear(tiles):
    return _tile(tiles, warps.sampled(F.col("embedding"), warps.resize_sources(8, 8, 12, 12)))


@query(f"""select vec_id, list_transform(list_transform(range(64), lambda k: {{
    'y': floor(4 + (k // 8 - 3.5e0) * cos(radians(30.0e0)) + (k % 8 - 3.5e0) * sin(radians(30.0e0))),
    'x': floor(4 - (k // 8 - 3.5e0) * sin(radians(30.0e0)) + (k % 8 - 3.5e0) * cos(radians(30.0e0)))}}),
  lambda p: case when p.y between 0 and 7 and p.x between 0 and 7 then round({_AT.format('p.y * 8 + p.x')}, 6) + 0.0e0 else 0.0e0 end) as tile
from tiles""", "tiles")
def rotate_tiles(tiles):
    return _tile(tiles, warps.sampled(F.col("embedding"), warps.rotation_sources(8, 8, 30)))


@query("""with b as (select vec_id, list_transform(embedding, lambda v: least(greatest(abs(cast(v as double)) * 1.2e0, 0), 1)) as b from tiles),
m as (select *, list_sum(b) / len(b) as m from b)
select vec_id, list_transform(b, lambda v: round(least(greatest((v - m) * 0.8e0 + m, 0), 1), 6)) as tile from m""", "tiles")
def color_jitter(tiles):
    return _tile(tiles, warps.jitter(F.transform("embedding", lambda v: F.abs(v.cast("double"))), 1.2, 0.8))


#: Corners of the old tile that the new one's corners show.
_CORNERS = np.array([(0.5, 0.25), (6.5, 0.0), (7.0, 6.75), (0.25, 7.0)])
_H = warps.homography(warps.corner_points(8, 8), _CORNERS)


def _row(k: int) -> str:
    """One row of the matrix applied to pixel k of the target."""
    a, b, c = (f"cast({v!r} as double)" for v in _H[k].tolist())
    return f"({a} * (k % 8) + {b} * (k // 8) + {c})"


_PLACES = f"'x': {_row(0)} / {_row(2)}, 'y': {_row(1)} / {_row(2)}"
_WEIGHED = " + ".join(f"case when floor(p.y) + {dy} between 0 and 7 and floor(p.x) + {dx} between 0 and 7 then (1 - abs(p.y - floor(p.y) - {dy})) * (1 - abs(p.x - floor(p.x) - {dx})) * {_AT.format(f'(floor(p.y) + {dy}) * 8 + floor(p.x) + {dx}')} else 0.0e0 end" for dy in (0, 1) for dx in (0, 1))


@query(f"select vec_id, list_transform(list_transform(range(64), lambda k: {{{_PLACES}}}), lambda p: round({_WEIGHED}, 6) + 0.0e0) as tile from tiles", "tiles")
def perspective_tiles(tiles):
    return _tile(tiles, warps.perspective(F.col("embedding"), 8, 8, _CORNERS))


_NEAREST = _AT.format("floor(p.y + 0.5e0) * 8 + floor(p.x + 0.5e0)")


@query(f"""select vec_id, list_transform(list_transform(range(64), lambda k: {{{_PLACES}}}),
  lambda p: case when floor(p.y + 0.5e0) between 0 and 7 and floor(p.x + 0.5e0) between 0 and 7 and {_NEAREST} > 0 then 1.0e0 else 0.0e0 end) as tile from tiles""", "tiles")
def perspective_labels(tiles):
    mask = F.transform("embedding", lambda v: F.when(v > 0, 1.0).otherwise(0.0))
    return _tile(tiles, warps.perspective(mask, 8, 8, _CORNERS, label=True))


_PICK = "('0x' || substr(md5(cast(vec_id as varchar) || '-21-{}'), 1, 8))::bigint / 4294967296.0e0"
_CROP = f"""a as (select vec_id, embedding, ({_PICK.format('area')} * 0.5e0 + 0.5e0) * 64 as area,
  exp({_PICK.format('ratio')} * (ln(4 / 3.0e0) - ln(0.75e0)) + ln(0.75e0)) as shape, {_PICK.format('y')} as uy, {_PICK.format('x')} as ux from tiles),
s as (select *, least(greatest(round(sqrt(area / shape)), 1), 8) as h, least(greatest(round(sqrt(area * shape)), 1), 8) as w from a),
c as (select *, floor(uy * (9 - h)) as y0, floor(ux * (9 - w)) as x0 from s)"""


@query(f"""with {_CROP} select vec_id, cast(h as bigint) as h, cast(w as bigint) as w, list_transform(range(36),
  lambda k: round({_AT.format('(y0 + floor((k // 6) * h / 6)) * 8 + x0 + floor((k % 6) * w / 6)')}, 6) + 0.0e0) as tile from c""", "tiles")
def random_resized_crop_labels(tiles):
    cut = warps.random_resized_crop(F.col("embedding"), 8, 8, 6, 6, F.col("vec_id"), 21, label=True)
    return _tile(tiles, cut).join(_crop_sides(tiles), "vec_id").select("vec_id", "h", "w", "tile")


_SAMPLE = " + ".join(f"{_AT.format(f'(y0 + least(floor(p.y) + {dy}, h - 1)) * 8 + x0 + least(floor(p.x) + {dx}, w - 1)')} * {'(p.y - floor(p.y))' if dy else '(1 - p.y + floor(p.y))'} * {'(p.x - floor(p.x))' if dx else '(1 - p.x + floor(p.x))'}" for dy in (0, 1) for dx in (0, 1))


@query(f"""with {_CROP} select vec_id, list_transform(list_transform(range(36), lambda k: {{
    'y': least(greatest((k // 6 + 0.5e0) * h / 6 - 0.5e0, 0), h - 1), 'x': least(greatest((k % 6 + 0.5e0) * w / 6 - 0.5e0, 0), w - 1)}}),
  lambda p: round({_SAMPLE}, 6) + 0.0e0) as tile from c""", "tiles")
def random_resized_crop(tiles):
    return _tile(tiles, warps.random_resized_crop(F.col("embedding"), 8, 8, 6, 6, F.col("vec_id"), 21))


def _crop_sides(tiles):
    """Sides of the part that random_resized_crop() takes, from the same hashes."""
    from .operators.selection import uniform

    pick = lambda name: uniform(F.concat(F.col("vec_id").cast("string"), F.lit(f"-21-{name}")))
    area, shape = (pick("area") * 0.5 + 0.5) * 64, F.exp(pick("ratio") * (np.log(4 / 3) - np.log(0.75)) + np.log(0.75))
    side = lambda v: F.least(F.greatest(F.round(v), F.lit(1.0)), F.lit(8.0)).cast("bigint")
    return tiles.select("vec_id", side(F.sqrt(area / shape)).alias("h"), side(F.sqrt(area * shape)).alias("w"))


# ---- from degrees to metres ------------------------------------------------------------------------------------------

#: The raster's pixels are 0.2 degrees from 10 east, 50 north; the target's are 20 km of the map projection.
_SOURCE = (0.2, 0.0, 10.0, 0.0, -0.2, 50.0)
_TARGET = (20000.0, 0.0, 1120000.0, 0.0, -20000.0, 6440000.0)
_ROWS, _COLUMNS = 142, 98
_GRID = f"""g as (select y, unnest(range({_COLUMNS})) as x from (select unnest(range({_ROWS})) as y)),
p as (
  select y, x, (50 - degrees(2 * atan(exp((6440000 - 20000 * (y + 0.5e0)) / 6378137.0e0)) - pi() / 2)) / 0.2e0 - 0.5e0 as sy,
    (degrees((1120000 + 20000 * (x + 0.5e0)) / 6378137.0e0) - 10) / 0.2e0 - 0.5e0 as sx from g)"""


def _place(y, x):
    mx, my = geometry.apply_affine(_TARGET, x + 0.5, y + 0.5)
    lon, lat = geometry.from_web_mercator(mx, my)
    column, row = geometry.index_of(_SOURCE, lon, lat)
    return row - 0.5, column - 0.5


@query(f"with {_GRID} select p.y, p.x, cast(ras.v as double) as v from p join ras on ras.y = cast(floor(sy + 0.5e0) as bigint) and ras.x = cast(floor(sx + 0.5e0) as bigint)", "ras")
def warp_nearest(ras):
    return warps.warp(ras, _ROWS, _COLUMNS, _place, method="nearest", size=32)


@query(f"""with {_GRID}, n as (
  select p.y, p.x, ras.v, (1 - abs(sy - ras.y)) * (1 - abs(sx - ras.x)) as w from p, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx), ras
  where ras.y = cast(floor(sy) as bigint) + d.dy and ras.x = cast(floor(sx) as bigint) + d.dx)
select y, x, round(sum(v * w) / sum(w), 6) as v from n where w > 0 group by y, x""", "ras")
def warp_bilinear(ras):
    return warps.warp(ras, _ROWS, _COLUMNS, _place, method="bilinear", size=32).withColumn("v", r9("v", 6))


# ---- on the sphere ---------------------------------------------------------------------------------------------------

@query("""with r as (select rect_id, x0 / 10 - 50 as lon0, x1 / 10 - 50 as lon1, y0 / 20 as lat0, y1 / 20 as lat1 from rects),
c as (select rect_id, [lon0, lon1, lon1, lon0, lon0] as x, [lat0, lat0, lat1, lat1, lat0] as y from r),
e as (select rect_id, x[k] as ax, y[k] as ay, x[k + 1] as zx, y[k + 1] as zy from c, range(1, 5) t(k)),
s as (
  select rect_id, 2 * atan2(tan(radians(zx - ax) / 2) * (tan(radians(ay) / 2) + tan(radians(zy) / 2)), 1 + tan(radians(ay) / 2) * tan(radians(zy) / 2)) as excess from e)
select rect_id, round(abs(sum(excess)) * 6371.0088e0 * 6371.0088e0, 4) as km2 from s group by rect_id""", "rects")
def sphere_areas(rects):
    from .operators.polygons import rings_of

    lon, lat = (lambda c: F.col(c) / 10 - 50), (lambda c: F.col(c) / 20)
    ring = [(lon("x0"), lat("y0")), (lon("x1"), lat("y0")), (lon("x1"), lat("y1")), (lon("x0"), lat("y1"))]
    return rects.select("rect_id", r9(geometry.sphere_area(rings_of(ring)[0], 6371.0088), 4).alias("km2"))


# ---- contrast and pixels ---------------------------------------------------------------------------------------------


@query(None, "tiles")
def clahe_tiles(tiles):
    from .operators.contrast import clahe, map_bands

    def one(tile):
        return clahe(np.rint(np.abs(tile[0]) % 1.0 * 255).astype(int), (2, 2), 2.0) / 255

    return map_bands(tiles.select("vec_id", F.col("embedding").alias("tile")), one, 1, 8, 8)


@query(None, "tiles")
def clahe_colours(tiles):
    from .operators.contrast import clahe_rgb, map_bands

    own = tiles.select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("tile"))
    return map_bands(own, lambda t: clahe_rgb(t, (2, 2), 2.0), 4, 4, 4)


@query("""select vec_id, list_transform(range(64), lambda k: case when ('0x' || substr(md5(cast(vec_id as varchar) || '-9-' || cast(k as varchar)), 1, 8))::bigint / 4294967296.0e0 < 0.05e0
  then 0.0e0 else round(cast(embedding[k + 1] as double), 6) + 0.0e0 end) as tile from tiles""", "tiles")
def random_pixels(tiles):
    from .operators.tiles import random_pixels as inner

    return _tile(tiles, inner(F.transform("embedding", lambda v: v.cast("double")), F.col("vec_id"), 0.05, 0.0, 9))
