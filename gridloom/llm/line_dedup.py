"""Line dedup by two Bloom filters.

Pass 1 enters each document's distinct line keys into a filter of once-seen hashes; what is entered again goes to a
second filter of twice-seen hashes. Filters of tasks merge by (a, b) + (c, d) = (a | c, b | d | a & c). Pass 2 sends
only keys that the second filter holds - suspected repeats - through a shuffle, which counts documents exactly and
finds the first occurrence. Pass 3 drops the confirmed lines from the texts where they lie: the confirmed keys are sent to
all tasks if there are few enough, and else joined with the documents that hold them; the texts of others never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import buffers, in_arrow, materialize, mix, release, slices, small_batches
from .filters import may_hold

#: Bits of each filter and the pieces in which they are merged. The size is fixed: it bounds the broadcast at 16 MB,
#: and a fuller filter only means more suspects to confirm. Raise it for larger inputs (16 bits a distinct line).
BITS, PIECES = 1 << 27, 64
#: Confirmed lines (24 bytes each) up to which their keys are sent to every task; more are joined by document.
SENT = 1 << 20
#: Bytes of text that are Python objects at once.
PART = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each \\n-split line: stripped of ASCII white space, A-Z lower-cased. A null text is one empty line."""
    lines = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split(b"\n")
    return [line.strip(SPACE) for line in lines]


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _slots(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each key."""
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    a = mix(words[:, 0]) % np.uint64(BITS)
    b = mix(words[:, 1] + np.uint64(1)) % np.uint64(BITS)
    return a.astype(np.int64), b.astype(np.int64)


def _own(text: str | None, least: int) -> set[bytes]:
    """Digests of a document's distinct keys of enough code points."""
    out = set()
    for key in set(line_keys(text)):
        if key and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least):
            out.add(_digest(key))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in parts of bounded size, each with its first row."""
    ends, _ = buffers(column)
    for a, b in slices(ends, PART):
        yield a, column.slice(a, b - a).to_pylist()


def _set(bits: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))


def _held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1


def _places(bits: np.ndarray) -> bytes:
    return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint32).tobytes()


def _filters(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The task's two filters as bit positions, in pieces."""
    once, twice = np.zeros(BITS // 8, np.uint8), np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        for _, texts in _texts(batch.column("text")):
            digests: list[bytes] = []
            for text in texts:
                digests.extend(_own(text, least))
            if not digests:
                continue
            unique, counts = np.unique(np.frombuffer(b"".join(digests), "V16"), return_counts=True)
            a, b = _slots([x.tobytes() for x in unique])
            again = (_held(once, a) & _held(once, b)).astype(bool) | (counts > 1)
            for slots in (a, b):
                _set(twice, slots[again])
                _set(once, slots)
    width = BITS // PIECES // 8
    for k in range(PIECES):
        own = slice(k * width, (k + 1) * width)
        if once[own].any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_places(once[own])], pa.binary()), pa.array([_places(twice[own])], pa.binary())], names=["piece", "once", "twice"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's filter of twice-seen hashes, as bytes."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for piece, once, twice in zip(*(batch.column(x).to_pylist() for x in ("piece", "once", "twice")), strict=True):
            if piece not in filters:
                filters[piece] = (np.zeros(BITS // PIECES // 8, np.uint8), np.zeros(BITS // PIECES // 8, np.uint8))
            one, two = filters[piece]
            new = np.frombuffer(once, np.uint32).astype(np.int64)
            _set(two, new[_held(one, new).astype(bool)])
            _set(two, np.frombuffer(twice, np.uint32).astype(np.int64))
            _set(one, new)
    yield pa.RecordBatch.from_arrays([pa.array(list(filters), pa.int32()), pa.array([two.tobytes() for _, two in filters.values()], pa.binary())], names=["piece", "bits"])


def repeat_filter(docs: DataFrame, min_chars: int = 1) -> np.ndarray:
    """The filter of keys that at least two documents of docs (text) hold: no false negatives."""
    pieces = in_arrow(docs.select("text"), lambda b: _filters(b, min_chars), "piece int, once binary, twice binary")
    bits = np.zeros(BITS // 8, np.uint8)
    width = BITS // PIECES // 8
    with small_batches(docs.sparkSession):
        merged = in_arrow(pieces.repartition(PIECES, "piece"), _merged, "piece int, bits binary").collect()  # 16 MB, whatever the data
    for row in merged:
        bits[row["piece"] * width : (row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _suspects(batches: Iterator[pa.RecordBatch], least: int, bits) -> Iterator[pa.RecordBatch]:
    """(doc_id, key) of the distinct keys of each document that the filter holds."""
    held = bits.value
    for batch in batches:
        ids = batch.column("doc_id")
        for first, texts in _texts(batch.column("text")):
            rows, digests = [], []
            for k, text in enumerate(texts):
                own = _own(text, least)
                digests.extend(own)
                rows.extend([first + k] * len(own))
            if not digests:
                continue
            a, b = _slots(digests)
            keep = np.flatnonzero(_held(held, a) & _held(held, b))
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[keep]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(rows)[keep])), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "k1", "k2"])


class Confirmed:
    """Keys of confirmed lines with the smallest doc_id that holds each (and whether there is one), sorted; says which
    lines go."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, first: np.ndarray, known: np.ndarray, keep_first: bool):
        order = np.lexsort((k2, k1))
        self.k1, self.k2, self.first, self.known, self.keep_first = k1[order], k2[order], first[order], known[order], keep_first
        runs = np.diff(np.flatnonzero(np.append(np.append(True, self.k1[1:] != self.k1[:-1]), True))) if len(k1) else np.zeros(1, int)
        self.longest = int(runs.max(initial=0))

    def gone(self, pairs: np.ndarray, docs: np.ndarray, known: np.ndarray) -> np.ndarray:
        """pairs: the two words of each line's key; docs: its doc_id; known: whether it has one."""
        out = np.zeros(len(pairs), bool)
        at = np.searchsorted(self.k1, pairs[:, 0])
        for step in range(self.longest):
            k = np.minimum(at + step, max(len(self.k1) - 1, 0))
            hit = (self.k1[k] == pairs[:, 0]) & (self.k2[k] == pairs[:, 1])
            if self.keep_first:
                hit &= (docs != self.first[k]) & known & self.known[k]
            out |= hit
        return out


def _dropped(batches: Iterator[pa.RecordBatch], held, extra: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the confirmed lines, rewritten where they lie."""
    confirmed: Confirmed = held.value
    for batch in batches:
        column = batch.column("doc_id")
        ids, known = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        for first, texts in _texts(batch.column("text")):
            keys = [line_keys(text) for text in texts]
            counts = np.array([len(k) for k in keys])
            pairs = np.frombuffer(b"".join([_digest(key) for own in keys for key in own]), np.int64).reshape(-1, 2)
            lost = confirmed.gone(pairs, *(np.repeat(x[first : first + len(texts)], counts) for x in (ids, known)))
            lost &= np.fromiter((bool(key) for own in keys for key in own), bool, len(pairs))
            stops = np.cumsum(counts)
            n = np.diff(np.append(0, np.cumsum(lost)[stops - 1]))
            out = []
            for text, cut, stop, size in zip(texts, n.tolist(), stops.tolist(), counts.tolist(), strict=True):
                out.append("\n".join([line for line, gone in zip((text or "").split("\n"), lost[stop - size : stop].tolist(), strict=True) if not gone]) if cut else text)
            yield _result(batch.slice(first, len(texts)), out, counts, n, extra)


def _result(batch: pa.RecordBatch, texts: list[str | None], lines, dropped, extra: bool) -> pa.RecordBatch:
    sums = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
    new = {"text": pa.array(texts, pa.string())} if extra else {}
    new |= {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
    names = [x for x in batch.schema.names if x not in (_GONE, "text")]
    return pa.RecordBatch.from_arrays([batch.column(x) for x in names] + list(new.values()), names=[*names, *new])


#: Names of inner columns, which no column of a table of documents is likely to have.
_GONE, _AFFECTED, _GONE_ID = "__gridloom_gone", "__gridloom_affected", "__gridloom_gone_id"


def _split(batches: Iterator[pa.RecordBatch], ids) -> Iterator[pa.RecordBatch]:
    """Rows with whether the id filter holds the document."""
    bits = ids.value
    for batch in batches:
        doc = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.append_column(_AFFECTED, pa.array(may_hold(bits, doc), pa.bool_()))


def _rewrite(batches: Iterator[pa.RecordBatch], extra: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose key is among the row's gone keys."""
    for batch in batches:
        for first, column in _texts(batch.column("text")):
            texts, lines, dropped = [], [], []
            for text, gone in zip(column, batch.column(_GONE).slice(first, len(column)).to_pylist(), strict=True):
                whole, cut = "" if text is None else text, 0
                lines.append(whole.count("\n") + 1)
                if gone:
                    lost = {g["k1"].to_bytes(8, "little", signed=True) + g["k2"].to_bytes(8, "little", signed=True) for g in gone}
                    keys = [not k or _digest(k) not in lost for k in line_keys(whole)]
                    cut = len(keys) - sum(keys)
                    whole = "\n".join(line for line, keep in zip(whole.split("\n"), keys, strict=True) if keep)
                texts.append(whole if cut or text is not None else None)
                dropped.append(cut)
            yield _result(batch.slice(first, len(texts)), texts, lines, dropped, extra)


def _suspected(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, k1, k2) of suspects, and (k1, k2, first_doc) of the confirmed among them."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeat_filter(docs, min_chars))
    found = materialize(in_arrow(docs.select("doc_id", "text"), lambda b: _suspects(b, min_chars, bits), "doc_id long, k1 long, k2 long"), "suspects")
    often = found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs)
    return found, materialize(often.select("k1", "k2", "first_doc"), "confirmed")


def _long_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def repeated_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, k1, k2, first_doc): in which documents the lines found in min_docs documents or more are, with the
    128-bit key of the line and the smallest doc_id that holds it. Each row counts as a document."""
    found, often = _suspected(_long_ids(docs), min_docs, min_chars)
    return found.join(often, ["k1", "k2"])


def line_dedup(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, texts: bool = True, sent: int = SENT) -> DataFrame:
    """docs (doc_id, text, any others) with repeated lines dropped, and n_lines, n_dropped, kept_sha256.

    A line goes if its key has min_chars code points or more and min_docs documents or more hold it; with keep_first it
    stays in the document of the smallest doc_id. Other lines stay as they are, joined by \\n. A null text counts as one
    empty line and stays null; empty keys never go; each row counts as a document, and rows with the same doc_id lose the same lines.
    Columns of docs by the names of the results are replaced. texts=False leaves the text column out. sent: confirmed lines
    up to which no text moves; the rows are the same either way.
    """
    docs = _long_ids(docs.drop("n_lines", "n_dropped", "kept_sha256"))
    if not texts:
        docs = docs.select("doc_id", "text")
    found, often = _suspected(docs, min_docs, min_chars)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    out += (", text string" if texts else "") + ", n_lines long, n_dropped long, kept_sha256 string"
    if often.count() <= sent:  # at most 24 bytes times sent
        rows = often.toArrow()
        first = rows["first_doc"]
        confirmed = Confirmed(rows["k1"].to_numpy(), rows["k2"].to_numpy(), first.fill_null(0).to_numpy(), first.is_valid().to_numpy(), keep_first)
        held = docs.sparkSession.sparkContext.broadcast(confirmed)
        release(found, often)
        return in_arrow(docs, lambda b: _dropped(b, held, texts), out)
    return _joined(docs, found.join(often, ["k1", "k2"]), keep_first, schema, out, texts)


def _joined(docs: DataFrame, gone: DataFrame, keep_first: bool, schema: str, out: str, texts: bool) -> DataFrame:
    """The documents with their confirmed lines by a join on the document, for more lines than can be sent."""
    from .ngram_jaccard import id_filter

    if keep_first:
        gone = gone.where("doc_id <> first_doc")
    gone = materialize(gone.select("doc_id", "k1", "k2").distinct(), "gone")
    held = id_filter(gone.select(F.coalesce("doc_id", F.lit(-1)).alias("id")))
    split = in_arrow(docs, lambda b: _split(b, held), f"{schema}, {_AFFECTED} boolean")
    kind = "array<struct<k1:bigint,k2:bigint>>"
    lists = gone.groupBy(F.col("doc_id").alias(_GONE_ID)).agg(F.collect_list(F.struct("k1", "k2")).alias(_GONE))
    touched = split.where(_AFFECTED).join(lists, F.col("doc_id").eqNullSafe(F.col(_GONE_ID)), "left").drop(_GONE_ID, _AFFECTED)
    others = split.where(f"not {_AFFECTED}").drop(_AFFECTED).withColumn(_GONE, F.lit(None).cast(kind))
    parts = [in_arrow(x, lambda b: _rewrite(b, texts), out) for x in (touched, others)]
    return parts[0].unionByName(parts[1])
