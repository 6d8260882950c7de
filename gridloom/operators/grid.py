"""Window grids over rasters: padded and dense patch grids, blocks, sub-ranges, offsets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored


def _steps(start: Column, stop: Column, step: Column) -> Column:
    """sequence() that is empty instead of failing where stop lies before start."""
    return F.when(stop >= start, F.sequence(start, F.greatest(stop, start), step)).otherwise(F.array().cast("array<bigint>"))


def _grid(df: DataFrame, ys: Column, xs: Column) -> DataFrame:
    """One row per (y, x), row-major: patch_idx, row_off, col_off."""
    out = df.select("*", F.posexplode(ys).alias("iy", "row_off"), xs.alias("_xs")).select("*", F.posexplode("_xs").alias("ix", "col_off"))
    return out.withColumn("patch_idx", (F.col("iy") * F.size("_xs") + F.col("ix")).cast("bigint")).drop("_xs").withColumns({"iy": F.col("iy").cast("bigint"), "ix": F.col("ix").cast("bigint")})


def _long(x: str | int) -> Column:
    return (F.col(x) if isinstance(x, str) else F.lit(x)).cast("bigint")


def patch_grid(regions: DataFrame, patch: int, overlap: int, padding: int) -> DataFrame:
    """Padded grid of regions (y0, x0, h, w in pixels): from y0 - padding, by patch - overlap, up to y0 + h - step + padding."""
    step, pad = patch - overlap, F.lit(padding)

    def axis(start: str, size: str) -> Column:
        return _steps(_long(start) - pad, _long(start) + _long(size) - step + pad, F.lit(step).cast("bigint"))

    return _grid(regions, axis("y0", "h"), axis("x0", "w"))


def patchify(rasters: DataFrame, patch: int, step: int) -> DataFrame:
    """Dense grid of whole patches of rasters (h, w)."""
    axis = lambda size: _steps(F.lit(0).cast("bigint"), _long(size) - patch, F.lit(step).cast("bigint"))
    return _grid(rasters, axis("h"), axis("w"))


def window_index(rasters: DataFrame, patch: int, step: int, *, partial: bool = True) -> DataFrame:
    """Unpadded windows while y <= h and x <= w, cut at the edge; without ``partial`` only whole patches."""
    axis = lambda size: _steps(F.lit(0).cast("bigint"), _long(size), F.lit(step).cast("bigint"))
    out = _grid(rasters, axis("h"), axis("w"))
    out = out.withColumns({"h_patch": F.least(_long("h") - F.col("row_off"), F.lit(patch)).cast("bigint"), "w_patch": F.least(_long("w") - F.col("col_off"), F.lit(patch)).cast("bigint")})
    return out if partial else out.where((F.col("h_patch") == patch) & (F.col("w_patch") == patch))


def window_range(rasters: DataFrame, patch: int, step: int, start: int, end: int) -> DataFrame:
    """Windows start to end (not included) of the row-major list, without building the others."""
    count = lambda size: F.greatest(F.floor((_long(size) - patch) / step) + 1, F.lit(0))  # noqa: E731  none in a raster smaller than a patch
    ny, nx = count("h"), count("w")
    ids = _steps(F.lit(start).cast("bigint"), F.least(F.lit(end), ny * nx) - 1, F.lit(1).cast("bigint"))
    out = rasters.select("*", nx.cast("bigint").alias("_nx"), F.explode(ids).alias("patch_idx"))
    return out.withColumns({"row_off": F.expr("patch_idx div _nx") * step, "col_off": F.expr("patch_idx % _nx") * step}).drop("_nx")


def raster_blocks(rasters: DataFrame, ysize: int, xsize: int) -> DataFrame:
    """Blocks of fixed size, the last row and column ragged."""
    axis = lambda size, by: _steps(F.lit(0).cast("bigint"), _long(size) - 1, F.lit(by).cast("bigint"))
    out = _grid(rasters, axis("h", ysize), axis("w", xsize))
    return out.withColumns({"row_end": F.least(F.col("row_off") + ysize, _long("h")), "col_end": F.least(F.col("col_off") + xsize, _long("w"))})


def training_offsets(rasters: DataFrame, patch: int, step: int) -> DataFrame:
    """Offsets of range(0, h - patch, step), which leaves the last aligned patch out, or 0 alone in a small raster."""
    def axis(size: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.when(_long(size) <= patch, F.array(zero)).otherwise(_steps(zero, _long(size) - patch - 1, F.lit(step).cast("bigint")))

    return _grid(rasters, axis("h"), axis("w"))


def pad_even(rasters: DataFrame, patch: int, overlap: int) -> DataFrame:
    """Padding to whole steps on each axis; a full step is added where the size is aligned already."""
    step = patch - overlap
    extra = {f"pad_{a}": (step - (_long(a) - patch) % step).cast("bigint") for a in ("h", "w")}
    out = rasters.withColumns(extra)
    return out.withColumns({f"{a}_top": F.expr(f"pad_{a} div 2") for a in ("h", "w")})


def balanced_split(df: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """rank: contiguous parts whose sizes differ by one at most, the larger first.

    ntile needs one order over all rows; rows are numbered by a range partitioning and per-partition counts instead.
    """
    return numbered(df, order).withColumn("rank", _tile(F.col("row_idx"), F.col("n_rows"), parts)).drop("row_idx", "n_rows")


def _tile(idx: Column, n: Column, parts: int) -> Column:
    small, rest = F.floor(n / parts), n % parts
    head = rest * (small + 1)
    return F.when(idx < head, F.floor(idx / (small + 1))).otherwise(rest + F.floor((idx - head) / F.greatest(small, F.lit(1)))).cast("bigint")


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions by order, with _part (partitions in order) and _key (a number that grows in that order within
    a partition), stored once.

    Counting and numbering have to read the same partitions. Planned twice, a range partitioning samples its bounds twice
    and a row could count in one partition and be numbered in another; so the order is stored, which cuts lineage too.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ordered.withColumn("_key", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_key", 33))
    return stored(local, "order")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """row_idx (from 0) in the given order and n_rows, without bringing all rows into one task.

    Rows are range-partitioned and sorted once; counts of the partitions (one row each) give the offsets.
    """
    local = _placed(df, order)
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n_rows"))  # a row a partition
    at = F.col("_key").bitwiseAND(F.lit((1 << 33) - 1))
    return local.join(F.broadcast(offsets), "_part").withColumn("row_idx", F.col("_before") + at).drop("_part", "_key", "_before")


def prefix_offsets(sizes: DataFrame, size: str, order: list[str]) -> DataFrame:
    """start_idx: the sum of the sizes of the rows before, two-phase: within range partitions, then across them."""
    local = _placed(sizes, order)
    totals = local.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    own = F.sum(size).over(Window.partitionBy("_part").orderBy("_key")) - F.col(size)
    return local.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("start_idx", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_key", "_own", "_before")


def numbered_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """row_idx (from 0) within each group in the given order and n_rows of the group; a large group spans many tasks.

    Rows are range-partitioned by group and order, so that a partition holds runs of groups; per group and partition one
    count gives the offset of the run.
    """
    local = _placed(df, [group, *order])
    runs = local.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_key").alias("_first"))
    w = Window.partitionBy(group)
    runs = runs.select(F.col(group).alias("_g"), "_part", "_first", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n_rows"))
    out = local.join(runs, (F.col(group).eqNullSafe(F.col("_g"))) & (local["_part"] == runs["_part"])).drop(runs["_part"])
    return out.withColumn("row_idx", F.col("_before") + F.col("_key") - F.col("_first")).drop("_part", "_key", "_first", "_before", "_g")


def within_blocks(df: DataFrame, group: str, order: list[str], before: int, block: int = 100_000) -> DataFrame:
    """df with _block and _halo: rows of each group in runs of block rows in the given order, each with copies (_halo) of the
    before rows ahead of it, and row_idx within the group. So a window of at most before rows back over (group, _block),
    ordered by row_idx, has all it needs, and no task gets a whole group. before is at most block."""
    rows = numbered_within(df, group, order).drop("n_rows")
    own = F.expr(f"row_idx div {block}")
    late = (F.col("row_idx") % block >= block - before) & F.lit(before > 0)
    return rows.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_halo", F.col("_block") > own)
