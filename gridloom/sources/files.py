"""Readers and writers: listings, vector text files, run configs, window caches, snapshots and tile tables."""

from __future__ import annotations

import json

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import SCHEMAS


@dataclass(frozen=True)
class ImageSource:
    """Where images come from: exactly one of a file, a folder or a database table (JDBC url and table)."""

    file: str | None = None
    folder: str | None = None
    database: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.file, self.folder, self.database)) != 1:
            raise ValueError("give exactly one of file, folder and database")

    def read(self, spark: SparkSession, extension: str = "*") -> DataFrame:
        """(path, ...) rows of the source, ordered by path where it is a listing."""
        if self.file is not None:
            return spark.createDataFrame([(self.file,)], "path string")
        if self.folder is not None:
            return list_files(spark, self.folder, f"*{extension.lstrip('*')}")
        url, table = self.database
        if not url.startswith(("jdbc:postgresql:", "jdbc:sqlite:")):
            raise ValueError("databases have to be PostgreSQL or SQLite")
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).load()


def list_files(spark: SparkSession, folder: str, glob: str = "*", *, prefix: str = "", recursive: bool = True) -> DataFrame:
    """(path, length) of files below folder whose name fits glob and begins with prefix; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    named = found.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    return named.where(F.col("name").startswith(prefix)).select("path", "length").orderBy("path")


def read_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, properties, kind, coordinates, x0, y0, x1, y1) of the features of GeoJSON files; multipolygons are exploded.

    Coordinates are rings of [x, y]; boxes are plain columns, so that filters on them reach later Parquet scans.
    """
    schema = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    read = spark.read.schema(schema).option("multiLine", "true").json(list(paths))
    rows = read.select(F.input_file_name().alias("source"), F.explode("features").alias("f"))
    rows = rows.select("source", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    polygon, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    one = rows.where("kind = 'Polygon'").withColumn("coordinates", F.from_json("text", polygon))
    many = rows.where("kind = 'MultiPolygon'").withColumn("coordinates", F.explode(F.from_json("text", multi))).withColumn("kind", F.lit("Polygon"))
    out = one.unionByName(many).drop("text")
    axis = lambda k: F.transform(F.flatten("coordinates"), lambda p: F.get(p, F.lit(k)))
    return out.withColumns({"x0": F.array_min(axis(0)), "y0": F.array_min(axis(1)), "x1": F.array_max(axis(0)), "y1": F.array_max(axis(1))})


def write_vectors(df: DataFrame, path: str) -> bool:
    """Write a vector layer as Parquet; nothing is written, and False returned, when it is empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def curve_key(box: tuple[str, str, str, str], bounds: tuple[float, float, float, float], bits: int = 16) -> Column:
    """The place of a box's middle on a Z-order curve over bounds (x0, y0, x1, y1): near middles have near places. The bits of
    the two coordinates, bits of each, are laid in turn."""
    x0, y0, x1, y1 = bounds
    most = (1 << bits) - 1
    cell = lambda a, b, low, high: F.least(F.greatest(F.floor(((F.col(a) + F.col(b)) / 2 - low) / ((high - low) or 1.0) * most), F.lit(0)), F.lit(most)).cast("bigint")

    def spread(v: Column) -> Column:
        """Bit k of v at 2 k: halves move apart, then quarters, and so on."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    return spread(cell(box[0], box[2], x0, x1)).bitwiseOR(F.shiftleft(spread(cell(box[1], box[3], y0, y1)), 1))


def write_clustered(df: DataFrame, path: str, box: tuple[str, str, str, str], *, files: int | None = None) -> bool:
    """Write a layer with boxes in the order of a space-filling curve, so that the least and greatest corners of a file, and of
    the row groups in it, span little: a filter by a box (operators.spatial.in_box) then skips most of them. Nothing is
    written, and False returned, when the layer is empty."""
    x0, y0, x1, y1 = box
    bounds = df.agg(F.min(x0), F.min(y0), F.max(x1), F.max(y1)).first()
    if bounds[0] is None:
        return False
    keyed = df.withColumn("_curve", curve_key(box, tuple(map(float, bounds))))
    ordered = keyed.repartitionByRange(files, "_curve") if files else keyed.repartitionByRange("_curve")
    ordered.sortWithinPartitions("_curve").drop("_curve").write.mode("overwrite").parquet(path)
    return True


def union_layers(spark: SparkSession, *paths: str) -> DataFrame:
    """Layers under each other with the file they come from."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("source", F.input_file_name())


def read_configs(spark: SparkSession, *paths: str) -> DataFrame:
    """Run configs of drifting key sets: one row per file, missing keys null."""
    return spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(list(paths)).withColumn("source", F.input_file_name())


def cached(spark: SparkSession, path: str, build, schema: str) -> DataFrame:
    """A table read from a CSV cache if it is there, else built and written first."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        build().write.option("header", "true").csv(path)
    return spark.read.schema(schema).option("header", "true").csv(path)


def save_tiles(tiles: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A tile table by year; an existing one stays unless told otherwise."""
    tiles.write.mode("overwrite" if overwrite else "ignore").partitionBy("year").parquet(path)


def load_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["tiles"]).parquet(path)


def read_windows(tiles: DataFrame, windows: DataFrame, *, fill: int = 0) -> DataFrame:
    """Pixels (patch_idx, tile_id, band, wy, wx, v) of windows (patch_idx, tile_id, col_off, row_off, width, height) of a
    tile table; what lies outside takes ``fill``."""
    cells = windows.select("patch_idx", "tile_id", "col_off", "row_off", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("wy"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("wx"))
    y, x = F.col("row_off").cast("int") + F.col("wy"), F.col("col_off").cast("int") + F.col("wx")
    joined = cells.join(tiles.select("tile_id", "h", "w", "bands", "data"), "tile_id").select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    inside = (y >= 0) & (y < F.col("h")) & (x >= 0) & (x < F.col("w"))
    value = F.when(inside, F.get("data", ((F.col("band") * F.col("h") + y) * F.col("w") + x).cast("int"))).otherwise(F.lit(fill))
    return joined.select("patch_idx", "tile_id", "band", "wy", "wx", value.cast("int").alias("v"))


def inspect(tiles: DataFrame) -> DataFrame:
    """Size and value range of each tile."""
    return tiles.select("tile_id", "h", "w", "bands", F.array_min("data").alias("lo"), F.array_max("data").alias("hi"))


def latest(listing: DataFrame) -> DataFrame:
    """The last path of a listing by name."""
    return listing.agg(F.max("path").alias("path"))


def first_existing(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Of candidates (id, path, rank) the first that exists (path), per id."""
    return wanted.join(existing.select("path"), "path", "left_semi").groupBy("id").agg(F.min_by("path", "rank").alias("path"))


def with_ordinal(df: DataFrame, group: str, order: str) -> DataFrame:
    """A 1-based ordinal within each group; a large group spans many tasks."""
    from ..operators.grid import numbered_within

    return numbered_within(df, group, [order]).withColumn("ordinal", (F.col("row_idx") + 1).cast("bigint")).drop("row_idx", "n_rows")


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    """A run config, split or file mapping as one JSON document, which read_configs() reads again. An existing file is an
    error."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def write_scores(scores: DataFrame, base: str, model: str, run: str, metrics: list[str], by: str | None = None) -> DataFrame:
    """Write the scores of one run of a model below base/model/run: csv (a row a patch) and log (a line of text for each value
    of by and one for all, with the number of patches and the mean of each metric). Returns the log (line). A run that is
    there already is an error; runs are told apart by their name."""
    scores.write.option("header", "true").csv(f"{base}/{model}/{run}/csv")
    means = [F.avg(m).alias(m) for m in metrics]
    total = scores.agg(F.count("*").alias("n"), *means).select(F.lit("all").alias("name"), "n", *metrics)
    if by:
        total = scores.groupBy(F.col(by).cast("string").alias("name")).agg(F.count("*").alias("n"), *means).unionByName(total)
    said = [F.format_string(f" {m} %.6f", F.col(m)) for m in metrics]
    log = total.select("name", F.concat(F.col("name"), F.lit(": "), F.col("n").cast("string"), F.lit(" patches"), *said).alias("line"))
    last = (F.col("name") == "all").cast("int")
    log = log.repartition(1).sortWithinPartitions(last, "name").select("line")  # a line for each group of a score table
    log.write.text(f"{base}/{model}/{run}/log")
    return scores.sparkSession.read.text(f"{base}/{model}/{run}/log").withColumnRenamed("value", "line")


def read_scores(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The score rows of all runs of all models below base, with model and run."""
    rows = spark.read.schema(schema).option("header", "true").csv(f"{base}/*/*/csv")
    part = lambda k: F.element_at(F.split(F.input_file_name(), "/"), k)
    return rows.withColumns({"model": part(-4), "run": part(-3)})
