"""Helpers shared by the training-data operators: shared-folder tables, Arrow buffers, byte hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text hashed at once; bounds the temporary arrays of a worker (about 40 bytes each).
SLICE_BYTES = 512 << 10
#: Bytes of rows that an operator is given at once, whatever the length of Spark's Arrow batches.
PART_BYTES = 4 << 20
#: Spark's bound on the bytes of an Arrow batch (64 MB if unset), and what tables of the operators' own are written with.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its Parquet path, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Where that is unset, a folder of this machine for a local master
    (tests), and an error for any other, whose executors would each write to a folder of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="gridloom-")
        shared_dir.own = at
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table's folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; removed when the driver ends."""
    if not _written:
        atexit.register(_drop_all, spark, _written)
    _written.append(path := f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}")
    return path


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own. For applications: no operator
    changes the settings of the session that it is given."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounded Arrow batches for the jobs that run meanwhile; the session's settings are as before afterwards."""
    unset = spark.conf.get(BATCH_KEY, None) is None
    bounded_batches(spark)
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(BATCH_KEY)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    with small_batches(spark):
        df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    freed()
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader has run."""
    for df in tables:
        drop_path(df.sparkSession, df.written_at)


def freed() -> None:
    """Give memory that this process no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose function gets rows of PART_BYTES at once, or one longer row, and whose tasks give their memory back
    to the system at the end; Spark keeps the worker for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(part for batch in batches for part in parts(batch))
        finally:
            freed()

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about so many bytes; nothing is copied."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        else:
            sizes += column.nbytes // len(column)
    for a, b in slices(np.append(0, np.cumsum(sizes)), most):
        yield batch.slice(a, b - a)


def small_side(df: DataFrame, name: str, most: int = 50_000) -> DataFrame:
    """df written once, and marked for broadcast if it has at most so many rows (of bounded width); else it is joined by
    a shuffle, whose hot keys adaptive execution splits."""
    own = materialize(df, name)
    if own.count() > most:
        return own
    out = F.broadcast(own)
    out.written_at = own.written_at
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if at is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(ends: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one longer row."""
    row, rows = 0, len(ends) - 1
    while row < rows:
        to = int(np.searchsorted(ends, ends[row] + most, "right")) - 1
        to = min(max(to, row + 1), rows)
        yield row, to
        row = to


def hashed_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and where each row's words begin (one more than rows).

    Words are runs of bytes outside space and \\t..\\r, which is safe in UTF-8; only A-Z are lower-cased.
    ends: row offsets into data; a row's end always ends a word.
    """
    first, last = int(ends[0]), int(ends[-1])
    raw = data[first:last]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~_WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends - first] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | cut[1:-1]
    at, to = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[_LOWER[raw]] * _power("up", _BASE, len(raw)), out=total[1:])
    value = (total[to] - total[at]) * _power("down", _INVERSE, len(raw) + 1)[at]
    value = mix(value + (to - at).astype(np.uint64) * _BASE)
    return value, np.searchsorted(at, ends - first)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence."""
    rolled = None
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * np.uint64(2 * k + 0xD6E8FEB86659FD93)
            rolled ^= rolled >> np.uint64(29)
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(b - a)
        if n >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif n:
            yield mix(np.array([int(np.bitwise_xor.reduce(mix(words[a:b] + np.arange(1, n + 1, dtype=np.uint64) * _BASE))) ^ (n * 0xA0761D6478BD642F & (1 << 64) - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def row_shingles(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """shingles() of each row of a text column."""
    ends, data = buffers(column)
    for a, b in slices(ends):
        words, bounds = hashed_words(data, ends[a : b + 1])
        yield from shingles(words, bounds, size)


def keeping_columns(docs: DataFrame, names: tuple[str, ...], stage) -> DataFrame:
    """stage(docs) with docs's own columns of the given names set aside meanwhile; only docs's columns are returned."""
    clash = {x: f"{x}__own" for x in docs.columns if x in names}
    out = stage(docs.withColumnsRenamed(clash))
    return out.drop(*clash).withColumnsRenamed({v: k for k, v in clash.items()}).select(*[f"`{c}`" for c in docs.columns])
