"""Joins of axis-aligned boxes and points by predicates, hash-partitioned on grid cells.

Theta joins plan as nested loops; here both sides are dealt to the grid cells that they touch, joined on the cell, and a
pair is kept only in the cell of its intersection's lower corner, so no pair comes twice and nothing is broadcast blindly.
Where many rows have one box, copy_join() and the aggregates over classes meet each distinct pair of boxes once only.
Cells come in levels, each of twice the side of the one below: a box lies in the few cells of the level of its own size, and
meets smaller boxes there, which are dealt to the coarser levels that the other side has. So one wide box makes no million
cells, and a pair meets at the level of its larger box only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _level(box: tuple[str, str, str, str], cell: float) -> Column:
    """The least level whose cells are as wide as the box; 0 for boxes up to the size of a cell."""
    x0, y0, x1, y1 = map(F.col, box)
    side = F.greatest(x1 - x0, y1 - y0)
    return F.greatest(F.ceil(F.log2(F.greatest(side / cell, F.lit(1.0)))), F.lit(0)).cast("int")


def _good(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.where((F.col(x1) >= F.col(x0)) & (F.col(y1) >= F.col(y0)))


def _levels(df: DataFrame, box: tuple[str, str, str, str], cell: float) -> list[int]:
    """The levels of a side, under a hundred of them."""
    return sorted(r[0] for r in _good(df, box).select(_level(box, cell).alias("l")).distinct().collect() if r[0] is not None)


def _cells(df: DataFrame, box: tuple[str, str, str, str], cell: float, levels: Column) -> DataFrame:
    """df dealt to the cells that it touches on each of the levels."""
    out = _good(df, box).select("*", F.explode(levels).alias("_level"))
    width = F.pow(F.lit(2.0), F.col("_level")) * cell
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    x0, y0, x1, y1 = box
    out = out.select("*", F.explode(F.sequence(at(x0), at(x1))).alias("_gx"))
    return out.select("*", F.explode(F.sequence(at(y0), at(y1))).alias("_gy"))


def box_join(left: DataFrame, right: DataFrame, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str], *, predicate: str = "intersects", cell: float = 100.0, how: str = "inner") -> DataFrame:
    """Pairs of rows whose boxes meet: intersects (touching counts), within (left inside right), covers (left around right).

    Column names of the two sides have to differ. how: inner, left_semi or left_anti. For the latter two the cells that a
    left row touches stay with it, and the row is dealt by its whole content: equal rows have equal answers, so that no row
    key is needed. cell should be near the least usual box size.
    """
    if how != "inner":
        hit = box_join(left.dropDuplicates(), right, lbox, rbox, predicate=predicate, cell=cell).select(*left.columns).dropDuplicates()
        hit = hit.select(*[F.col(c).alias(f"_hit_{k}") for k, c in enumerate(left.columns)])
        same = F.lit(True)
        for k, c in enumerate(left.columns):
            same = same & F.col(c).eqNullSafe(F.col(f"_hit_{k}"))
        return left.join(hit, same, how)
    lx0, ly0, lx1, ly1 = map(F.col, lbox)
    rx0, ry0, rx1, ry1 = map(F.col, rbox)
    meet = (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1)
    width = F.pow(F.lit(2.0), F.col("_level")) * cell
    meet &= (F.floor(F.greatest(lx0, rx0) / width) == F.col("_gx")) & (F.floor(F.greatest(ly0, ry0) / width) == F.col("_gy"))
    if predicate == "within":
        meet &= (lx0 >= rx0) & (lx1 <= rx1) & (ly0 >= ry0) & (ly1 <= ry1)
    elif predicate == "covers":
        meet &= (lx0 <= rx0) & (lx1 >= rx1) & (ly0 <= ry0) & (ly1 >= ry1)
    elif predicate != "intersects":
        raise ValueError(f"unknown predicate {predicate}")
    here, there = _levels(left, lbox, cell), _levels(right, rbox, cell)
    mine, others = _level(lbox, cell), _level(rbox, cell)
    above = lambda levels, own: F.filter(F.lit(levels).cast("array<int>"), lambda k: k > own)
    keys = ["_level", "_gx", "_gy"]
    # At its own level a left box meets right boxes of that level or below; then the other way round. Two small boxes never
    # meet in a large cell.
    out = _cells(left, lbox, cell, F.array(mine)).join(_cells(right, rbox, cell, F.concat(F.array(others), above(here, others))), keys).where(meet)
    if here and there and there[-1] > here[0]:
        out = out.unionByName(_cells(left, lbox, cell, above(there, mine)).join(_cells(right, rbox, cell, F.array(others)), keys).where(meet))
    return out.drop(*keys)


def spread(pairs: DataFrame, left: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str], *, rows: int = 2048) -> DataFrame:
    """Pairs of classes (lkeys, rkeys, any others) with every row of left that has the lkeys and every row of right that has the
    rkeys. A class of left is dealt to parts of about so many rows, each a group of the join, so that no task gets all pairs of
    a large class; right should be the smaller side. Names of the three tables but the keys have to differ."""
    sizes = left.groupBy(*lkeys).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    own = left.join(sizes, lkeys).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")).drop("_parts")
    other = pairs.join(right, rkeys).join(sizes, lkeys)
    other = other.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_parts")
    return own.hint("merge").join(other, [*lkeys, "_part"]).drop("_part")


def copy_join(left: DataFrame, right: DataFrame, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str], *, predicate: str = "intersects", cell: float = 100.0) -> DataFrame:
    """The rows of box_join(), where many rows may have the same box: distinct boxes are compared, and their rows follow by
    equality, so that what is compared grows with the distinct boxes and the rest with the result."""
    pairs = box_join(left.select(*dict.fromkeys(lbox)).distinct(), right.select(*dict.fromkeys(rbox)).distinct(), lbox, rbox, predicate=predicate, cell=cell)
    return spread(pairs, left, right, list(dict.fromkeys(lbox)), list(dict.fromkeys(rbox)))


def met_lists(left: DataFrame, right: DataFrame, key: str, value: str, lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str], out: str, *, cell: float = 100.0) -> DataFrame:
    """(key, out): for each key of left the sorted values of the rows of right that its boxes meet, once for each of its rows;
    keys that meet nothing are left out. Keys of the same boxes share one list, which is put together once."""
    own, others = list(dict.fromkeys(lbox)), list(dict.fromkeys(rbox))
    held = left.where(" and ".join(f"{c} is not null" for c in own)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_boxes"))
    kinds = held.select("_boxes").distinct()
    boxed = kinds.select("_boxes", F.explode("_boxes").alias("_box")).select("_boxes", *[F.col(f"_box.{c}").alias(c) for c in own])
    pairs = box_join(boxed.select(*own).distinct(), right.select(*others).distinct(), lbox, rbox, cell=cell)
    met = boxed.join(pairs, own).join(right.select(value, *others), others)
    lists = met.groupBy("_boxes").agg(F.sort_array(F.collect_list(value)).alias(out))
    return held.join(lists, "_boxes").select(key, out)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Columns renamed with a prefix, for self joins."""
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def in_box(box: tuple[str, str, str, str], x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a row's box meets the given one; the comparisons reach the Parquet scan."""
    return (F.col(box[0]) <= x1) & (F.col(box[2]) >= x0) & (F.col(box[1]) <= y1) & (F.col(box[3]) >= y0)


def intersection(lbox: tuple[str, str, str, str], rbox: tuple[str, str, str, str]) -> dict[str, Column]:
    """The corners of the intersection of two boxes."""
    return {"ix0": F.greatest(lbox[0], rbox[0]), "iy0": F.greatest(lbox[1], rbox[1]), "ix1": F.least(lbox[2], rbox[2]), "iy1": F.least(lbox[3], rbox[3])}
