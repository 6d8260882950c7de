"""An endless stream of training batches: a Python data source whose offset is the number of the next batch.

A batch's draws are hashes of the seed, its number and the draw, so a batch that is read again, after a failure or from
another checkpoint, is the same. The draws become frames by a join with the frames' cumulated weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructType

SCHEMA = StructType().add("batch", LongType()).add("draw", LongType()).add("u", DoubleType())


def drawn(seed: str, batch: int, draw: int) -> float:
    """A number in [0, 1) of a draw: the first 8 hex digits of md5('seed-batch-draw') / 2^32."""
    return int(hashlib.md5(f"{seed}-{batch}-{draw}".encode()).hexdigest()[:8], 16) / 4294967296.0


class Part(InputPartition):
    """Draws first to stop (not included) of a batch."""

    def __init__(self, batch: int, first: int, stop: int):
        self.batch, self.first, self.stop = batch, first, stop


class _Reader:
    """Options: seed, draws (a batch's size), batches (how many a step of the stream takes, or a batch read has), part (draws of
    a task)."""

    def __init__(self, options: dict[str, str]):
        self.seed = options.get("seed", "0")
        self.draws, self.each = int(options.get("draws", 64)), int(options.get("batches", 1))
        self.part = int(options.get("part", 100_000))

    def parts(self, first: int, stop: int) -> list[Part]:
        return [Part(b, a, min(a + self.part, self.draws)) for b in range(first, stop) for a in range(0, self.draws, self.part)]

    def rows(self, part: Part) -> Iterator[tuple[int, int, float]]:
        for draw in range(part.first, part.stop):
            yield part.batch, draw, drawn(self.seed, part.batch, draw)


class BatchReader(_Reader, DataSourceReader):
    """The first batches, as a table."""

    def partitions(self) -> list[Part]:
        return self.parts(0, self.each)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)


class BatchStreamReader(_Reader, DataSourceStreamReader):
    """Batch after batch, without an end."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self.next = (self.next or 0) + self.each
        return {"batch": self.next}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.next = max(self.next or 0, end["batch"])  # after a restart the stream goes on from its checkpoint
        return self.parts(start["batch"], end["batch"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TrainingBatches(DataSource):
    """format("training_batches"): rows (batch, draw, u)."""

    @classmethod
    def name(cls) -> str:
        return "training_batches"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return BatchStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrainingBatches)


def frame_spans(frames: DataFrame, key: str, weight: str, cells: int = 1024) -> DataFrame:
    """(cell, low, high, key): each frame's span of [0, 1) by its share of all weights (in thousandths, rounded; none for a
    weight of 0), in each of the cells that it reaches into. One prefix sum over range partitions."""
    from ..operators.grid import prefix_offsets

    scaled = frames.select(key, F.round(F.col(weight) * 1000).cast("bigint").alias("_w")).where("_w > 0")
    total = scaled.agg(F.sum("_w")).first()[0] or 1
    spans = prefix_offsets(scaled, "_w", [key]).select(key, (F.col("start_idx") / total).alias("low"), ((F.col("start_idx") + F.col("_w")) / total).alias("high"))
    last = F.least(F.ceil(F.col("high") * cells) - 1, F.lit(cells - 1))
    return spans.select(F.explode(F.sequence(F.floor(F.col("low") * cells), last)).alias("cell"), "low", "high", key)


def batches_of(draws: DataFrame, spans: DataFrame, key: str, cells: int = 1024) -> DataFrame:
    """(batch, draw, key): the frame of each draw, of a table or a stream of draws; spans by frame_spans() with as many cells."""
    asked = draws.withColumn("cell", F.floor(F.col("u") * cells))
    return asked.join(spans, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("batch", "draw", key)
