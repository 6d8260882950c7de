"""A content-addressed store of token ids.

Each document's id stream is cut into chunks where a rolling hash of its last ids says so, so equal passages give equal
chunks. A chunk is stored once, under a hash of its ids. A document is a recipe: its chunk keys in order, the Merkle
root over them, and where its ids begin in the whole stream. Recipes are in ascending doc_id order in shards; the
manifest holds each shard's ids, documents and Merkle root. Reading recomputes every key and root and fails on any
difference.

Format, in Parquet folders below one path: pack/kind=chunk (k1, k2, n, payload: ids in little-endian words of `width`
bytes), recipes (uid, doc_id, n_tokens, shard, start_in_shard, root, chunks: 20 bytes each, key and count), manifest
(shard, n_ids, n_docs, first_id, root, width).
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .common import buffers, in_arrow, mix, slices, small_batches
from .units import SLICE, Units, added_strings, unit_ids

#: Chunks have LEAST to MOST ids; between them a cut follows where the rolling hash has MASK bits zero.
LEAST, MOST, MASK, WINDOW = 128, 4096, 511, 8
_CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)
_units: dict[str, Units] = {}


def _encoder(path: str) -> Units:
    if path not in _units:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        _units[path] = Units(lambda units: unit_ids(tokenizer, units), np.zeros(0, np.uint32), whole=added_strings(tokenizer))
    return _units[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of a column of whole texts (null: empty) and how many each has, by slices of rows."""
    units = _encoder(path)
    ends, data = buffers(column)
    for a, b in slices(ends, SLICE):
        yield units.values(data, ends[a : b + 1])[:2]


def chunk_ends(ids: np.ndarray, stops: np.ndarray) -> list[int]:
    """Where the chunks of the id streams that end at stops end, by their contents: no chunk is of two streams.

    The rolling hash runs over the begin of a stream into the one before it, but a cut so near to the begin is never made.
    """
    code = _CODES[ids & 0xFFFF]
    rolled = code.copy()
    for k in range(1, WINDOW):
        rolled[k:] += code[:-k] << np.uint32(k)
    marks = np.flatnonzero((rolled >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    marks = np.concatenate([marks, stops])
    last, ends = 0, []
    order = np.argsort(marks, kind="stable")
    final = (np.arange(len(marks)) >= len(marks) - len(stops))[order]
    for at, stop in zip(marks[order].tolist(), final.tolist(), strict=True):
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at > last and (stop or at - last >= LEAST):
            last = at
            ends.append(at)
    return ends


def _key(ids: bytes | memoryview) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of the binary hash tree over leaves; an odd one goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[k] + level[k + 1], digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


_PACK = "place long, kind string, k1 long, k2 long, n int, payload binary, uid long, doc_id long, n_tokens long, root binary, chunks binary"
_TYPES = {"place": pa.int64(), "kind": pa.string(), "k1": pa.int64(), "k2": pa.int64(), "n": pa.int32(), "payload": pa.binary(), "uid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "chunks": pa.binary()}


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Rows of the pack; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[x], kind) if x in columns else pa.nulls(rows, kind) for x, kind in _TYPES.items()], names=list(_TYPES))


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int) -> Iterator[pa.RecordBatch]:
    """Recipes of a task's documents, and each of its chunks once."""
    number, sent = TaskContext.get().partitionId() << 40, set()
    for batch in batches:
        docs, row = batch.column("doc_id"), 0
        for ids, counts in encoded(batch.column("text"), path):
            n = len(counts)
            stops = np.cumsum(counts + 1)
            words = np.full(int(stops[-1]), end, "<u4")
            inner = np.ones(len(words), bool)
            inner[stops - 1] = False
            words[inner] = ids
            ends = chunk_ends(words, stops)
            raw, payload = memoryview(words).cast("B"), memoryview(words.astype(f"<u{width}")).cast("B")
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            keys = [_key(raw[4 * a : 4 * b]) for a, b in spans]
            new = []
            for k, key in enumerate(keys):
                if key not in sent:
                    sent.add(key)
                    new.append(k)
            if new:
                pairs = np.frombuffer(b"".join([keys[k] for k in new]), "<i8").reshape(-1, 2)
                yield _batch(len(new), place=pairs[:, 0], kind=["chunk"] * len(new), k1=pairs[:, 0], k2=pairs[:, 1], n=[spans[k][1] - spans[k][0] for k in new], payload=[bytes(payload[width * spans[k][0] : width * spans[k][1]]) for k in new])
            parts = np.searchsorted(ends, stops).tolist()
            uids = np.arange(number, number + n)
            roots, lists, begin = [], [], 0
            for stop in parts:
                roots.append(merkle(keys[begin : stop + 1]))
                lists.append(b"".join([keys[k] + (spans[k][1] - spans[k][0]).to_bytes(4, "little") for k in range(begin, stop + 1)]))
                begin = stop + 1
            yield _batch(n, place=[int(x) * -7046029254386353131 % (1 << 62) for x in uids], kind=["recipe"] * n, uid=uids, doc_id=docs.slice(row, n), n_tokens=counts + 1, root=roots, chunks=lists)
            number += n
            row += n


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks of different tasks, the first."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True), strict=True):
            keep.append(kind != "chunk" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes with their shard and first id in it."""
    shard, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        before = start + np.cumsum(n) - n
        start += int(n.sum())
        yield batch.append_column("shard", pa.array(np.full(len(n), shard), pa.int32())).append_column("start_in_shard", pa.array(before, pa.int64()))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest entry of each shard in a partition that holds whole shards in order."""
    found: dict[int, list] = {}
    for batch in batches:
        for shard, n, root in zip(*(batch.column(x).to_pylist() for x in ("shard", "n_tokens", "root")), strict=True):
            entry = found.setdefault(shard, [0, 0, hashlib.blake2b(digest_size=16)])
            entry[0] += n
            entry[1] += 1
            entry[2].update(root)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([e[0] for e in found.values()], pa.int64()), pa.array([e[1] for e in found.values()], pa.int64()), pa.array([e[2].digest() for e in found.values()], pa.binary())], names=["shard", "n_ids", "n_docs", "root"])


def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, width: int = 2) -> None:
    """Encode docs (doc_id, text; other columns are ignored) and write a store at path, a folder that must not exist.

    A null or empty text is the end id alone; rows with the same doc_id are documents of their own, next to each other;
    a null doc_id comes first. width: bytes of a stored id, 2 for vocabularies of at most 65,536 ids, else 4.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = in_arrow(in_arrow(docs, lambda b: _pack(b, tokenizer, end_id, width), _PACK).repartition("place"), _once, _PACK)
    with small_batches(spark):
        rows.drop("place").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/pack")
    kind = rows.drop("place", "kind").schema
    if not _exists(spark, f"{path}/pack/kind=recipe"):
        recipes = spark.createDataFrame([], kind)
    else:
        recipes = spark.read.schema(kind).parquet(f"{path}/pack/kind=recipe")
    recipes = recipes.select("uid", "doc_id", "n_tokens", "root", "chunks")
    ordered = recipes.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    in_arrow(ordered, _shards, "uid long, doc_id long, n_tokens long, root binary, chunks binary, shard int, start_in_shard long").write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    entries = recipes.select("shard", "start_in_shard", "doc_id", "uid", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "start_in_shard", "uid")
    found = in_arrow(entries, _roots, "shard int, n_ids long, n_docs long, root binary").toPandas().sort_values("shard")  # a row a shard
    found["first_id"] = found["n_ids"].cumsum() - found["n_ids"]
    found["width"] = width
    spark.createDataFrame(found[["shard", "n_ids", "n_docs", "first_id", "root", "width"]], "shard int, n_ids long, n_docs long, first_id long, root binary, width int").coalesce(1).write.parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _digests(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each stored chunk's crc32 as 32-bit words; fails where the ids are not those of the key."""
    for batch in batches:
        sums = []
        for k1, k2, n, payload in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "n", "payload")), strict=True):
            ids = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
            if len(ids) != 4 * n or _key(ids) != np.array([k1, k2], "<i8").tobytes():
                raise ValueError(f"chunk {k1:x}.{k2:x} does not hold the ids of its key")
            sums.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(sums, pa.int64())], names=["k1", "k2", "crc"])


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo crc32's."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


_shift: dict[int, int] = {}


def crc32_of_both(first: int, second: int, length: int) -> int:
    """The crc32 of two strings one after the other, from theirs and the second's length."""
    if length not in _shift:
        power, square, n = 1 << 31, 1 << 23, length  # x^0 and x^8
        while n:
            if n & 1:
                power = _times(power, square)
            square = _times(square, square)
            n >>= 1
        if len(_shift) > 100_000:
            _shift.clear()
        _shift[length] = power
    return _times(first, _shift[length]) ^ second


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from their chunks in order; fails where a root or a count differs."""
    for batch in batches:
        sums = []
        for n, root, parts in zip(*(batch.column(x).to_pylist() for x in ("n_tokens", "root", "parts")), strict=True):
            parts.sort(key=lambda p: p["seq"])
            if sum(p["n"] for p in parts) != n or merkle([np.array([p["k1"], p["k2"]], "<i8").tobytes() for p in parts]) != root:
                raise ValueError("a document's chunks are not those of its recipe")
            crc = 0
            for p in parts:
                crc = crc32_of_both(crc, p["crc"], 4 * p["n"])
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe."""
    for batch in batches:
        lists = [np.frombuffer(x, np.dtype([("k1", "<i8"), ("k2", "<i8"), ("n", "<i4")])) for x in batch.column("chunks").to_pylist()]
        times = np.array([len(x) for x in lists], np.int64)
        every = np.concatenate(lists) if lists else np.zeros(0, np.dtype([("k1", "<i8"), ("k2", "<i8"), ("n", "<i4")]))
        take = pa.array(np.repeat(np.arange(len(lists)), times))
        kept = [batch.column(x).take(take) for x in ("uid", "doc_id", "start", "n_tokens", "root")]
        seq = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
        yield pa.RecordBatch.from_arrays([*kept, pa.array(seq.astype(np.int32)), *(pa.array(np.ascontiguousarray(every[x])) for x in ("k1", "k2", "n"))], names=["uid", "doc_id", "start", "n_tokens", "root", "seq", "k1", "k2", "n"])


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    manifest = spark.read.parquet(f"{path}/manifest")
    first = manifest.select("width").first()
    recipes = spark.read.parquet(f"{path}/recipes").join(F.broadcast(manifest.select("shard", "first_id")), "shard")  # a row a shard
    recipes = recipes.withColumn("start", F.col("first_id") + F.col("start_in_shard"))
    if first is None:
        return recipes, spark.createDataFrame([], "k1 long, k2 long, n int, payload binary"), 2
    return recipes, spark.read.parquet(f"{path}/pack/kind=chunk").select("k1", "k2", "n", "payload"), first["width"]


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files, every key and root checked.

    Chunks don't move: each is read where it lies, and a document's crc32 is combined from its chunks'.
    """
    recipes, chunks, width = _opened(spark, path)
    entries = in_arrow(recipes.select("uid", "doc_id", "start", "n_tokens", "root", "chunks"), _entries, "uid long, doc_id long, start long, n_tokens long, root binary, seq int, k1 long, k2 long, n int")
    sums = in_arrow(chunks, lambda b: _digests(b, width), "k1 long, k2 long, crc long")
    by = entries.join(sums, ["k1", "k2"], "left").groupBy("uid", "doc_id", "start", "n_tokens", "root").agg(F.collect_list(F.struct("seq", "k1", "k2", "n", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing"))).alias("crc"))).alias("parts"))
    return in_arrow(by.select("doc_id", "start", "n_tokens", "root", "parts"), _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _joined(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for parts in batch.column("parts").to_pylist():
            parts.sort(key=lambda p: p["seq"])
            ids.append(np.frombuffer(b"".join(p["payload"] for p in parts), f"<u{width}").astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document: the id streams themselves, end ids included."""
    recipes, chunks, width = _opened(spark, path)
    entries = in_arrow(recipes.select("uid", "doc_id", "start", "n_tokens", "root", "chunks"), _entries, "uid long, doc_id long, start long, n_tokens long, root binary, seq int, k1 long, k2 long, n int")
    by = entries.join(chunks.drop("n"), ["k1", "k2"]).groupBy("uid", "doc_id", "start").agg(F.collect_list(F.struct("seq", "payload")).alias("parts"))
    return in_arrow(by.select("doc_id", "start", "parts"), lambda b: _joined(b, width), "doc_id long, start long, ids array<int>")
