"""Bloom filters over 64-bit keys, built by tasks, merged by pieces and fetched by one bounded job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, mix, small_batches

#: Bits of a piece that tasks' bits are merged in, and the most tasks that merge pieces.
PIECE, PIECES = 1 << 20, 256
#: Least and greatest number of bits: a filter is as large as its keys ask for, up to 64 MB, which bounds its broadcast. A
#: fuller filter lets more through, never less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29


def bits_for(keys: int, each: int = 16) -> int:
    """A power of two of about so many bits for each key."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (each * max(keys, 1) - 1).bit_length()))


def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each key (uint64)."""
    h = mix(keys + np.uint64(0x632BE59BD9B4E019))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter (bytes) may hold each key; false for none that it was built from."""
    x, y = slots(keys, 8 * len(filled))
    return ((filled[x >> 3] >> (x & 7) & 1) & (filled[y >> 3] >> (y & 7) & 1)).astype(bool)


def _filled(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The positions of the bits that the task's keys set, by piece."""
    width, pieces = min(PIECE, bits), max(1, bits // PIECE)
    for batch in batches:
        keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at = np.unique(np.concatenate(slots(keys, bits)))
        edges = np.searchsorted(at, np.arange(pieces + 1) * width)
        full = [k for k in range(pieces) if edges[k] < edges[k + 1]]
        places = [(at[edges[k] : edges[k + 1]] - k * width).astype(np.uint32).tobytes() for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(places, pa.binary())], names=["piece", "places"])


def _merged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, places in zip(batch.column("piece").to_pylist(), batch.column("places"), strict=True):
            own = found.setdefault(piece, np.zeros(min(PIECE, bits) // 8, np.uint8))
            at = np.frombuffer(places.as_buffer(), np.uint32)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["piece", "filled"])


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter (bytes) of the only column of keys, a long; nulls are left out."""
    parts = in_arrow(in_arrow(keys, lambda b: _filled(b, bits), "piece int, places binary").repartition(min(PIECES, max(1, bits // PIECE)), "piece"), lambda b: _merged(b, bits), "piece int, filled binary")
    out = np.zeros(bits // 8, np.uint8)
    width = min(PIECE, bits) // 8
    with small_batches(keys.sparkSession):
        rows = parts.collect()
    for row in rows:  # one row for each piece, bits / 8 bytes in all
        out[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["filled"], np.uint8)
    return out
