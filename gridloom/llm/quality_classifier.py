"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Random indexing gives each word a fixed sparse random index vector; a word's vector is its own index vector plus those
of its neighbours, summed over all documents, so words met in like company are alike. Words live in hashed rows
of fixed number; words of one shape (runs of upper case, lower case, digits and each sign) share further rows, so that
new words have a vector too. The sums are whole numbers: tasks add up their own tables of fixed size and the tables are
added piece by piece. A document is the mean of its words' vectors. The network is fitted on a bounded labelled sample,
of which the driver gets the pooled vectors, and its temperature on held back rows of that sample, so that its outputs
are probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _WHITE, buffers, hashed_words, in_arrow, mix, slices, small_batches

#: Rows of word and shape vectors, and numbers in a vector: with them 9 MB are broadcast, whatever the data.
WORDS, SHAPES, WIDTH = 1 << 16, 1 << 12, 32
WINDOW = 2
#: Pieces in which the tables of tasks are added, and bytes of text that are looked at once.
PIECES, PART = 64, 256 << 10
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 0xFE, 0x61, 0x30, 0x61


@dataclass
class QualityModel:
    """Vector rows and the network's weights; without weights (prior set) every text has the prior as its score."""

    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] | None
    temperature: float
    prior: float


def _rows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a slice their vector row and shape row, and where each text's words begin."""
    words, bounds = hashed_words(data, ends)
    first, last = int(ends[0]), int(ends[-1])
    raw = _SHAPE[data[first:last]]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != raw[:-1]) | _WHITE[raw[1:]]
    cut = ends - first
    keep[cut[cut < len(raw)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes, _ = hashed_words(raw[keep], place[cut])
    return (words % np.uint64(WORDS)).astype(np.int64), (shapes % np.uint64(SHAPES)).astype(np.int64), bounds


def _index(rows: int, seed: int) -> np.ndarray:
    """Sparse random index vectors: four entries of +1 or -1 a row, from a hash of the row."""
    out = np.zeros((rows, WIDTH), np.float32)
    h = mix(np.arange(rows, dtype=np.uint64) + np.uint64(seed))
    for k in range(4):
        at = (h >> np.uint64(8 * k) & np.uint64(WIDTH - 1)).astype(np.int64)
        out[np.arange(rows), at] += np.where(h >> np.uint64(40 + k) & np.uint64(1), 1, -1)
    return out


def _pool(model_words: np.ndarray, model_shapes: np.ndarray, column: pa.Array) -> np.ndarray:
    """The mean word and shape vectors of each text; zeros without words."""
    ends, data = buffers(column)
    out = np.zeros((len(ends) - 1, 2 * WIDTH), np.float32)
    for a, b in slices(ends, PART):
        words, shapes, bounds = _rows(data, ends[a : b + 1])
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if len(full):
            for k, (table, rows) in enumerate(((model_words, words), (model_shapes, shapes))):
                out[a + full, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(table[rows], bounds[:-1][full], axis=0) / n[full, None]
    return out


def _add_neighbours(total: np.ndarray, index: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> None:
    """Add to the rows of total the index vectors of the words at most WINDOW places away in the same text."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = np.zeros((len(rows), WIDTH), np.int8)
    for k in range(1, WINDOW + 1):
        same = (of[k:] == of[:-k])[:, None]
        near[k:] += index[rows[:-k]] * same
        near[:-k] += index[rows[k:]] * same
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0)) if len(rows) else np.zeros(0, int)
    if len(rows):
        total[rows[order[first]]] += np.add.reduceat(near[order].astype(np.int32), first, axis=0)


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of neighbours' index vectors for word rows and shape rows, in compressed pieces."""
    index = [_index(n, seed).astype(np.int8) for n, seed in ((WORDS, 1), (SHAPES, 7))]
    total = np.zeros((WORDS + SHAPES, WIDTH), np.int32)
    parts = total[:WORDS], total[WORDS:]
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, PART):
            words, shapes, bounds = _rows(data, ends[a : b + 1])
            for table, own, rows in zip(parts, index, (words, shapes), strict=True):
                _add_neighbours(table, own, rows, bounds)
    step = len(total) // PIECES
    for k in range(PIECES):
        if (piece := total[k * step : (k + 1) * step]).any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["piece", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, sums in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(sums), np.int32).astype(np.int64)
            total[piece] = total[piece] + more if piece in total else more
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "sums"])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the word rows and of the shape rows, from the company that words keep in all texts of docs (text)."""
    total = np.zeros((WORDS + SHAPES, WIDTH), np.int64)
    step = len(total) // PIECES
    pieces = in_arrow(docs.select("text"), _company, "piece int, sums binary").repartition(PIECES, "piece")
    with small_batches(docs.sparkSession):
        merged = in_arrow(pieces, _added, "piece int, sums binary").collect()  # tables of fixed size, 18 MB
    for row in merged:
        total[row["piece"] * step : (row["piece"] + 1) * step] = np.frombuffer(row["sums"], np.int64).reshape(step, WIDTH)
    return _unit(_index(WORDS, 1), total[:WORDS]), _unit(_index(SHAPES, 7), total[WORDS:])


def _unit(index: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Index vectors plus the sums of their company, each of unit length, scaled to unit length."""
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    out = index / np.linalg.norm(index, axis=1, keepdims=True).clip(1e-6) + total / norm.clip(1e-6)
    return (out / np.linalg.norm(out, axis=1, keepdims=True).clip(1e-6)).astype(np.float32)


def _pooled(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """(quality, x: the pooled vectors as bytes) of labelled texts."""
    for batch in batches:
        x = _pool(*held.value, batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), pa.array([row.tobytes() for row in x], pa.binary())], names=["order", "quality", "x"])


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def _fit(x: np.ndarray, y: np.ndarray, hidden: int, rounds: int) -> list[np.ndarray]:
    """A tanh layer and a logistic output, by Adam on the whole sample."""
    rng = np.random.default_rng(8)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, rounds + 1):
        h, z = _forward(x, layers)
        miss = (1 / (1 + np.exp(-z)) - y) / len(y)
        back = np.outer(miss, layers[2]) * (1 - h * h)
        slopes = [x.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ miss + 1e-4 * layers[2], np.array([miss.sum()])]
        for k, slope in enumerate(slopes):
            first[k] += 0.1 * (slope - first[k])
            second[k] += 0.01 * (slope * slope - second[k])
            layers[k] = layers[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes held back labels likeliest."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = 5000, hidden: int = 32, rounds: int = 400) -> QualityModel:
    """Fit on the texts of docs (doc_id, text) with labels (doc_id, quality 0 or 1).

    train_rows bounds the labelled sample: the ids of the least hash, whose pooled vectors the driver reads (256 bytes a
    document; ids that several rows share count each). All texts of docs shape the word vectors. A fifth of it is held back
    for the temperature. Null ids or labels are not used, and of several labels of an id the largest; with one class or
    none the score is that class's share, or 0.5.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(train_rows)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vectors = word_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = docs.join(F.broadcast(chosen), "doc_id").select(F.xxhash64(F.lit("quality"), "doc_id", "text").alias("order"), F.col("quality").cast("int").alias("quality"), "text")
    sample = in_arrow(sample, lambda b: _pooled(b, held), "order long, quality int, x binary").orderBy("order").toArrow()  # a few hundred bytes a row
    y = (sample.column("quality").to_numpy() > 0).astype(np.float64)
    if len(set(y)) < 2:
        empty = np.zeros(2 * WIDTH)
        return QualityModel(*vectors, empty, empty + 1, None, 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(len(y), 2 * WIDTH).astype(np.float64)
    back = np.arange(len(y)) % 5 == 0
    if len(set(y[~back])) < 2 or not back.any():
        back = np.zeros(len(y), bool)
    mean, scale = x[~back].mean(0), x[~back].std(0) + 1e-3
    layers = _fit((x[~back] - mean) / scale, y[~back], hidden, rounds)
    fit = back if back.any() else ~back
    warm = _temperature(_forward((x[fit] - mean) / scale, layers)[1], y[fit])
    return QualityModel(*vectors, mean, scale, layers, warm, float(y.mean()))


def probabilities(model: QualityModel, column: pa.Array) -> np.ndarray:
    """The calibrated probability of label 1 of each text."""
    if model.layers is None:
        return np.full(len(column), model.prior)
    x = (_pool(model.words, model.shapes, column) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(_forward(x, model.layers)[1] / model.temperature, -500, 500)))


def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(["text"]).append_column("score", pa.array(probabilities(held.value, batch.column("text")), pa.float64()))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (text, any others) with score in place of text: the probability of label 1, for null and empty texts too.
    A column by the name score is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    return in_arrow(docs, lambda b: _score(b, held), schema + "score double")
