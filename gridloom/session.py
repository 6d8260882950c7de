"""A SparkSession with the settings that the engine expects, and tables of its own in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "gridloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; master and shuffle partitions only where given, so that a cluster's own
    settings hold."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the SparkContext's own checkpoint folder.
    Where both are unset, a folder of this machine for a local master, and an error for any other, whose executors would each
    write to a folder of their own."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(shared_folder, "own", None)
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = shared_folder.own = tempfile.mkdtemp(prefix="gridloom-")
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_left: dict[str, SparkSession] = {}


def _delete_left() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, and lost executors cost nothing. The
    files go with forget(), or when the driver ends."""
    spark = df.sparkSession
    if not _left:
        atexit.register(_delete_left)
    path = f"{shared_folder(spark)}/gridloom-engine/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader has run."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)
        _left.pop(df.stored_at, None)
