"""Further queries over the bridge views: loss variants, labels, bounds, lookups, stitching into tiles and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import metrics as M
from .operators import mosaic, selection, zonal
from .queries import _REG, _regions, query, r9

# ---- losses ----------------------------------------------------------------------------------------------------------


def _overlap(hit: str, wrong: str, missed: str, kind: str) -> str:
    if kind == "dice":
        return f"(2 * {hit} + 1) / (2 * {hit} + {wrong} + {missed} + 1)"
    a, b = ("1", "1") if kind == "iou" else ("0.3e0", "0.7e0")
    return f"({hit} + 1) / ({hit} + {a} * {wrong} + {b} * {missed} + 1)"


_FG, _BG = ("sum(prob * t)", "sum(prob * (1 - t))", "sum((1 - prob) * t)"), ("sum((1 - prob) * (1 - t))", "sum((1 - prob) * t)", "sum(prob * (1 - t))")


@query(f"""select patch_id, yr, round(-({_overlap(*_FG, "dice")} + {_overlap(*_BG, "dice")}) / 2, 9) as dice, round(-({_overlap(*_FG, "iou")}), 9) as iou_fg,
  round(-({_overlap(*_FG, "tversky")} + {_overlap(*_BG, "tversky")}) / 2, 9) as tversky,
  round(pow(1 - ({_overlap(*_FG, "tversky")} + {_overlap(*_BG, "tversky")}) / 2, 0.75e0), 9) as focal from px group by patch_id, yr""", "px")
def loss_soft_overlap(px):
    return px.groupBy("patch_id", "yr").agg(
        r9(M.soft_overlap_loss("dice")).alias("dice"), r9(M.soft_overlap_loss("iou", background=False)).alias("iou_fg"), r9(M.soft_overlap_loss("tversky")).alias("tversky"), r9(M.focal_overlap_loss()).alias("focal")
    )


@query(f"""select yr, round(-({_overlap(*_FG, "dice")} + {_overlap(*_BG, "dice")}) / 2, 9) as dice, round(-({_overlap(*_FG, "tversky")}), 9) as tversky_fg from px group by yr""", "px")
def loss_soft_overlap_batch(px):
    return px.groupBy("yr").agg(r9(M.soft_overlap_loss("dice")).alias("dice"), r9(M.soft_overlap_loss("tversky", background=False)).alias("tversky_fg"))


_W = "(1 + 0.5e0 * p)"


def _tversky(p: str, t: str, w: str, a: str, b: str, eps: str) -> str:
    hit = f"sum({w} * {p} * {t})"
    return f"(1 - ({hit} + {eps}) / ({hit} + {a} * sum({w} * {p} * (1 - {t})) + {b} * sum({w} * (1 - {p}) * {t}) + {eps}))"


@query(f"""select patch_id, yr, round(pow({_tversky("prob", "t", _W, "0.4e0", "0.6e0", "1e-6")}, 1 / (1 + avg(t * 100.0e0) / 200)), 9) as dynamic,
  round({_tversky("prob", "t", f"abs({_W})", "0.5e0", "0.5e0", "100")} + 0.2e0 * {_tversky("(1 - prob)", "(1 - t)", f"abs(1 - {_W})", "0.5e0", "0.5e0", "100")}, 9) as two_sided
from px group by patch_id, yr""", "px")
def loss_tversky_variants(px):
    w, cover = 1 + 0.5 * F.col("p"), F.col("t") * 100.0
    return px.groupBy("patch_id", "yr").agg(r9(M.dynamic_tversky(w, cover)).alias("dynamic"), r9(M.two_sided_tversky(w)).alias("two_sided"))


# ---- labels, sizes, bounds, lookups ----------------------------------------------------------------------------------


@query(f"with {_REG} select rect_id, h, w from g where h >= 256 and w >= 256", "rects")
def rasters_of_a_patch(rects):
    return _regions(rects).where("h >= 256 and w >= 256").select("rect_id", "h", "w")


@query("select o_orderkey, case when s <> 0 then 1 else 0 end as binary, least(greatest(s, 0), 1) as clipped from (select o_orderkey, cast(o_custkey % 7 - 3 as int) as s from orders)", "orders")
def label_cleanup(orders):
    s = (F.col("o_custkey") % 7 - 3).cast("int")
    return orders.select("o_orderkey", F.when(s != 0, 1).otherwise(0).alias("binary"), F.least(F.greatest(s, F.lit(0)), F.lit(1)).alias("clipped"))


@query("""with p as (select c_custkey, 'out/centroids/' || cast(c_custkey as varchar) || '.gpkg' as layer from customer),
r as (select s_suppkey, 'out/rasters/' || cast(s_suppkey as varchar) || '.tif' as raster from supplier)
select p.layer, r.raster from p join r on r.raster = replace(replace(p.layer, 'centroids', 'rasters'), '.gpkg', '.tif')""", "customer", "supplier")
def layer_rasters(customer, supplier):
    layers = customer.select(F.concat(F.lit("out/centroids/"), F.col("c_custkey").cast("string"), F.lit(".gpkg")).alias("layer"))
    rasters = supplier.select(F.concat(F.lit("out/rasters/"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("raster"))
    derived = F.regexp_replace(F.regexp_replace("layer", "/centroids/", "/rasters/"), r"\.gpkg$", ".tif")
    return layers.withColumn("raster", derived).join(rasters, "raster").select("layer", "raster")


@query("select (max(y1) + min(y0)) / 2 as central from rects", "rects")
def central_latitude(rects):
    return rects.agg(((F.max("y1") + F.min("y0")) / 2).alias("central"))


@query("select yr, min(src_row) as first_row, max(src_row) as last_row, count(distinct id) as ids from foot group by yr", "foot")
def bounds_and_distinct(foot):
    return foot.groupBy("yr").agg(F.min("src_row").alias("first_row"), F.max("src_row").alias("last_row"), F.count_distinct("id").alias("ids"))


@query("select min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from rects", "rects")
def total_bounds(rects):
    return rects.agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


@query("""select vec_id, list_transform(embedding[1:48], lambda v: cast(v as double)) as image, list_transform(embedding[49:56], lambda v: case when v > 0 then 1 else 0 end) as label,
  list_transform(embedding[57:64], lambda v: cast(v as double)) as weight from tiles""", "tiles")
def split_bands(tiles):
    e = F.col("embedding")
    double = lambda a: F.transform(a, lambda v: v.cast("double"))
    return tiles.select("vec_id", double(F.slice(e, 1, 48)).alias("image"), F.transform(F.slice(e, 49, 8), lambda v: F.when(v > 0, 1).otherwise(0)).alias("label"), double(F.slice(e, 57, 8)).alias("weight"))


# ---- stitching and mappings ------------------------------------------------------------------------------------------


@query("""with k as (select cast(ceil(sqrt(max(vec_id) + 1)) as bigint) as c, max(vec_id) + 1 as n from tiles),
p as (select vec_id // c as gy, vec_id % c as gx, (n + c - 1) // c as ny, c as nx, embedding from tiles, k),
s as (select *, 8 - 2 - case when gy = ny - 1 then 3 else 2 end as h, 8 - 1 - case when gx = nx - 1 then 2 else 1 end as w from p)
select gy * 4 as y0, gx * 6 as x0, cast(h as bigint) as h, cast(w as bigint) as w, list_transform(range(h * w), lambda i: round(cast(embedding[cast((i // w + 2) * 8 + i % w + 1 + 1 as bigint)] as double), 6) + 0.0e0) as tile from s""", "tiles")
def unpatchify_tiles(tiles):
    n = (tiles.agg(F.max("vec_id")).first()[0] or 0) + 1
    columns = -int(-(n**0.5) // 1)
    patches = tiles.select(F.expr(f"vec_id div {columns}").alias("gy"), (F.col("vec_id") % columns).alias("gx"), F.col("embedding").alias("tile"))
    out = mosaic.stitch_tiles(patches, 8, 8, -(-n // columns), columns, (2, 3, 1, 2))
    return out.withColumn("tile", F.transform("tile", lambda v: F.round(v.cast("double"), 6)))


@query("""with m as (select 0 as dataset, row_number() over (order by rect_id) - 1 as row_ from rects union all select 1, row_number() over (order by crown_id) - 1 from crowns)
select row_number() over (order by md5('42-' || cast(dataset as varchar) || '-' || cast(row_ as varchar)), dataset, row_) - 1 as idx, cast(dataset as bigint) as dataset, row_ as row from m""", "rects", "crowns")
def shuffled_datasets(rects, crowns):
    return selection.concatenated([(rects, ["rect_id"]), (crowns, ["crown_id"])], seed=42)


#: Ways to scale pixel values, by name: (pixels with v, group columns) to a column.
NORMALISERS = {
    "none": lambda df, group: F.col("v").cast("double"),
    "fixed": lambda df, group: (F.col("v") - 0.5) / 0.25,
    "byte": lambda df, group: F.col("v") / 255.0,
    "zscore": lambda df, group: zonal.zscore(df, group, "v"),
}


def normalised(df, name: str, group: list[str]):
    """df with v by a normaliser's name."""
    if name not in NORMALISERS:
        raise ValueError(f"the normaliser has to be one of {tuple(NORMALISERS)}")
    return df.withColumn("v", NORMALISERS[name](df, group))


@query("""with n as (select patch_id, yr, p, t, prob, avg(prob) over (partition by patch_id) as m, stddev_pop(prob) over (partition by patch_id) as s from px)
select patch_id, yr, p, t, round((prob - 0.5e0) / 0.25e0, 6) as fixed, round((prob - m) / (s + 1e-8), 6) as zscore from n""", "px")
def normalise_by_name(px):
    own = px.withColumn("v", F.col("prob"))
    fixed = normalised(own, "fixed", ["patch_id"]).withColumnRenamed("v", "fixed").withColumn("v", F.col("prob"))
    return normalised(fixed, "zscore", ["patch_id"]).select("patch_id", "yr", "p", "t", r9("fixed", 6).alias("fixed"), r9("v", 6).alias("zscore"))

