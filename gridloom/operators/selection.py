"""Selection, ranking, sampling and the work queue's relational parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import forget, stored


def hash_order(key: str, seed: int) -> Column:
    """An order that looks random and that other engines can repeat: md5 of key and seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. A partial aggregate, so no key's rows meet in one task."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, *[f"_row.{c}" for c in others])


def latest_status(events: DataFrame) -> DataFrame:
    """The current status of each queue entry of an append-only log (id, seq, status)."""
    return events.groupBy("id").agg(F.max_by("status", "seq").alias("status"))


def queue_pop(queue: DataFrame, run: str, n: int = 1) -> DataFrame:
    """The n queued entries of highest priority; ties go to the smaller id."""
    return queue.where((F.col("run_name") == run) & (F.col("status") == "queued")).orderBy(F.desc("priority"), "id").limit(n)


def top_n(df: DataFrame, metric: str, key: str, n: int, best: bool = True) -> DataFrame:
    return df.orderBy(F.desc(metric) if best else F.asc(metric), key).limit(n)


def kfold(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """fold: position in hash order modulo k."""
    from .grid import numbered

    return numbered(df.withColumn("_h", hash_order(key, seed)), ["_h", key]).withColumn("fold", (F.col("row_idx") % k).cast("bigint")).drop("_h", "row_idx", "n_rows")


def split_share(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """part: test for the first floor(n * share) rows in hash order, else train."""
    from .grid import numbered

    ranked = numbered(df.withColumn("_h", hash_order(key, seed)), ["_h", key])
    return ranked.withColumn("part", F.when(F.col("row_idx") < F.floor(F.col("n_rows") * share), "test").otherwise("train")).drop("_h", "row_idx", "n_rows")


def weighted_sample(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """draws rows with replacement, by weight: each draw is a point of the cumulated weights, and takes the last row that
    begins at or before it. Points and rows are put in one order, in range partitions; a partition that begins with points
    gets the last row of those before it. So neither a heavy row nor a heavy weight makes a large group.

    Draw j's point is (first 8 hex digits of md5('seed-j')) / 2^32 of the total.
    """
    from .grid import _placed, prefix_offsets

    scaled = df.select(key, (F.round(F.col(weight) * 1000)).cast("bigint").alias("_w")).where("_w > 0")
    spans = prefix_offsets(scaled, "_w", [key])
    total = scaled.agg(F.sum("_w").alias("_t"))
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))).alias("_u"))
    points = points.crossJoin(F.broadcast(total)).withColumn("_at", F.floor(F.col("_u") * F.col("_t")).cast("bigint"))  # one row
    none = F.lit(None)
    rows = spans.select(F.col("start_idx").alias("_at"), F.lit(0).alias("_kind"), none.cast("bigint").alias("draw"), F.struct(key).alias("_row"))
    asked = points.select("_at", F.lit(1).alias("_kind"), "draw", none.cast(rows.schema["_row"].dataType).alias("_row"))
    local = _placed(rows.unionAll(asked), ["_at", "_kind"])
    ends = local.groupBy("_part").agg(F.max_by("_row", F.when(F.col("_kind") == 0, F.col("_key"))).alias("_end"))
    carry = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))  # a row a partition
    met = F.last("_row", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    found = local.withColumn("_met", met).where("_kind = 1").join(F.broadcast(carry), "_part")
    return found.select("draw", F.coalesce("_met", "_carry").alias("_row")).select("draw", f"_row.{key}")


def early_stop(log: DataFrame, run: str, order: str, metric: str, higher: bool = True) -> DataFrame:
    """best so far and how many evaluations passed since the last strict improvement, per run."""
    w = Window.partitionBy(run).orderBy(order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max if higher else F.min
    out = log.withColumn("best", best(metric).over(sofar)).withColumn("_old", best(metric).over(before))
    new = F.col("_old").isNull() | ((F.col(metric) > F.col("_old")) if higher else (F.col(metric) < F.col("_old")))
    out = out.withColumn("improved", new).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(sofar)
    return out.withColumn("stale", (F.col("_n") - last).cast("bigint")).drop("_old", "_n")


def sample_share(df: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """The first ceil(share * n) rows of each group in hash order; a large group spans many tasks."""
    from .grid import numbered_within

    ranked = numbered_within(df.withColumn("_h", hash_order(key, seed)), group, ["_h", key])
    return ranked.where(F.col("row_idx") < F.ceil(share * F.col("n_rows"))).drop("_h", "row_idx", "n_rows")


def sample_with_replacement(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(draw, key): draws rows, each with equal chance, repeats allowed. Draw j takes the row whose position in order of key
    is floor(u * n), u being (first 8 hex digits of md5('seed-j')) / 2^32."""
    from .grid import numbered

    rows = numbered(df.select(key), [key])
    total = df.agg(F.count("*").alias("_t"))
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))).alias("_u"))
    points = points.crossJoin(F.broadcast(total)).withColumn("row_idx", F.floor(F.col("_u") * F.col("_t")).cast("bigint"))  # one row
    return points.join(rows, "row_idx").select("draw", key)


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a text's md5, which other engines can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def frame_choice(frames: DataFrame, key: str, weight: str, draws: int, seed: int, uniform_share: float = 0.01) -> DataFrame:
    """(draw, key): frames for training patches. Most draws go by weight, a share of uniform_share goes to all frames alike,
    so that frames of little weight are met too. Which of both a draw is depends on md5('seed-u-j')."""
    by_weight = weighted_sample(frames, key, weight, draws, seed)
    alike = sample_with_replacement(frames, key, draws, seed + 1)
    chance = uniform(F.concat(F.lit(f"{seed}-u-"), F.col("draw").cast("string")))
    return by_weight.where(chance >= uniform_share).unionByName(alike.where(chance < uniform_share))


def concatenated(parts: list[tuple[DataFrame, list[str]]], seed: int | None = None) -> DataFrame:
    """(idx, dataset, row): the place of each row of several tables under each other. parts: each table with the columns that
    order and tell apart its rows. row is the row's number in its table; with a seed, idx is the place in an order by md5 of
    seed, table and row, else tables and rows follow each other."""
    from .grid import numbered

    whole = None
    for k, (df, order) in enumerate(parts):
        own = numbered(df.select(*order), order).select(F.lit(k).cast("bigint").alias("dataset"), F.col("row_idx").cast("bigint").alias("row"))
        whole = own if whole is None else whole.unionByName(own)
    by = ["dataset", "row"]
    if seed is not None:
        whole = whole.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("dataset").cast("string"), F.col("row").cast("string"))))
        by = ["_h", *by]
    return numbered(whole, by).select(F.col("row_idx").cast("bigint").alias("idx"), "dataset", "row")


def coverage_select(foot: DataFrame, *, share: float = 0.95, scale: int = 100) -> DataFrame:
    """Greedy footprints (id, yr, integer corners ix0, iy0, ix1, iy1), the newest year first: an older one is added if no
    chosen newer one meets it, or if those that do cover under ``share`` of it. Years don't compete within themselves. Each row
    is a footprint of its own, also where ids repeat.

    One step a year (a bounded number), which stores that year's rows only. Coverage is exact: a candidate is cut into
    vertical strips at the sides of the chosen boxes that meet it, and the union of the boxes' spans in each strip is
    measured by a running maximum. Cost goes with the number of meeting boxes, not with their area.
    """
    from .spatial import box_join, prefixed

    years = [r[0] for r in foot.select("yr").distinct().orderBy(F.desc("yr")).collect()]
    box = ("ix0", "iy0", "ix1", "iy1")
    parts: list[DataFrame] = []
    for year in years:
        own = foot.where(F.col("yr") == year)
        if not parts:
            parts.append(stored(own, "chosen"))
            continue
        own = stored(own.withColumn("_row", F.monotonically_increasing_id()), "year")
        chosen = parts[0].select(*box)
        for part in parts[1:]:
            chosen = chosen.unionByName(part.select(*box))
        met = box_join(own.select("_row", *box), prefixed(chosen, "c_"), box, tuple(f"c_{b}" for b in box), cell=float(scale))
        cut = met.select("_row", *[f(f"c_{b}", b).alias(b) for f, b in ((F.greatest, "ix0"), (F.greatest, "iy0"), (F.least, "ix1"), (F.least, "iy1"))])
        cut = cut.where("ix1 > ix0 and iy1 > iy0").distinct()
        edges = cut.select("_row", F.explode(F.array("ix0", "ix1")).alias("sx0")).distinct()
        strips = edges.withColumn("sx1", F.lead("sx0").over(Window.partitionBy("_row").orderBy("sx0"))).where("sx1 is not null")
        inside = strips.join(cut, "_row").where("ix0 <= sx0 and ix1 >= sx1")
        before = Window.partitionBy("_row", "sx0").orderBy("iy0", "iy1").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.max("iy1").over(before)
        new = F.greatest(F.lit(0), F.col("iy1") - F.greatest(F.col("iy0"), F.coalesce(seen, F.col("iy0"))))
        covered = inside.withColumn("_new", new * (F.col("sx1") - F.col("sx0"))).groupBy("_row").agg(F.sum("_new").alias("covered"))
        area = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0"))
        keep = own.join(covered, "_row", "left").where(F.coalesce("covered", F.lit(0)) < share * area).drop("covered", "_row")
        parts.append(stored(keep.select(*foot.columns), "chosen"))
        forget(own)
    if not parts:
        return foot
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
