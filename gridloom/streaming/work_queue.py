"""The prioritised work queue as an append-only status log, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.selection import latest_status, queue_pop

EVENTS = "id BIGINT, run_name STRING, priority INT, seq BIGINT, status STRING, msg STRING"


def append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Add status events to the log; a row is never changed."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their latest status."""
    events = spark.read.schema(EVENTS).parquet(path)
    entries = events.groupBy("id").agg(F.min_by("run_name", "seq").alias("run_name"), F.min_by("priority", "seq").alias("priority"), F.max("seq").alias("seq"))
    return entries.join(latest_status(events), "id")


def work(spark: SparkSession, path: str, run: str, process: Callable[[int], None], most: int | None = None) -> int:
    """Take the queued entry of the highest priority until none is left. A failure is logged as error; an interrupted
    entry goes back to queued. Returns how many were completed. One writer a log. most: entries to take at most."""
    done = taken = 0
    while most is None or taken < most:
        taken += 1
        entry = queue_pop(current(spark, path), run).first()
        if entry is None:
            return done
        seq = entry["seq"]
        append(spark, path, [(entry["id"], run, entry["priority"], seq + 1, "started", None)])
        try:
            process(entry["id"])
        except KeyboardInterrupt:
            append(spark, path, [(entry["id"], run, entry["priority"], seq + 2, "queued", "interrupted")])
            raise
        except Exception as error:
            append(spark, path, [(entry["id"], run, entry["priority"], seq + 2, "error", str(error)[:500])])
            continue
        append(spark, path, [(entry["id"], run, entry["priority"], seq + 2, "completed", None)])
        done += 1
    return done


def stream_status(spark: SparkSession, path: str, name: str) -> StreamingQuery:
    """The latest status of each entry, kept up to date in a memory table by a streaming aggregate."""
    events = spark.readStream.schema(EVENTS).parquet(path)
    return latest_status(events).writeStream.outputMode("complete").format("memory").queryName(name).start()


def stream_best(spark: SparkSession, scores: DataFrame, sink: str, metric: str, key: str, n: int) -> StreamingQuery:
    """The n best rows so far, merged with each micro-batch and written to sink/<batch>."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        past = [f"{sink}/{number - 1}"] if number else []
        best = batch if not past else batch.unionByName(session.read.parquet(*past))
        best.orderBy(F.desc(metric), key).limit(n).write.mode("overwrite").parquet(f"{sink}/{number}")

    return scores.writeStream.foreachBatch(merge).option("checkpointLocation", f"{sink}/_checkpoint").start()
