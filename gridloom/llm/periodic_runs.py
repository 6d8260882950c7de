"""Runs of periodic words by harmonic grid probing.

A run of period p and at least three periods has two neighbouring points jp, (j + 1) p of the grid of step p whose words
equal the words one period on. So for each p only the grid is probed: n / p comparisons, n log n for all periods. Points
that survive this and a few probes between them are extended in both directions by comparing chunks of arrays that double,
and grid points within a run that is found, of this period or of one that divides it, are skipped. The words of many texts
are laid one after another, longest text first, so that one array operation probes them all and a period ends with the
texts that are too short for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _WHITE, buffers, in_arrow, slices

#: Bytes of text whose words are laid side by side.
SLICE = 2 << 20
#: First chunk of an extension; later ones double.
CHUNK = 32

#: From each text's id and number of words (> 0), the word from which it repeats and the period; a period of 0 leaves it.
Rewrite = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words (bytes) of the rows of data, and where each row's words begin (one more than rows)."""
    first, last = int(ends[0]), int(ends[-1])
    raw = data[first:last]
    word = ~_WHITE[raw]
    own = ends - first
    cut = np.zeros(len(raw) + 1, bool)
    cut[own] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    at = np.flatnonzero(begins)
    before = np.append(0, np.cumsum(word))
    offsets = np.append(before[at], before[-1])
    packed = raw[word]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    return words, np.searchsorted(at, own)


def _agree(codes: np.ndarray, at: int, p: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch [from, to) around at within [low, high - p) where each word equals the word p on."""
    to, size = at, CHUNK
    while to < high - p:
        stop = min(to + size, high - p)
        off = np.flatnonzero(codes[to:stop] != codes[to + p : stop + p])
        if len(off):
            to += int(off[0])
            break
        to, size = stop, 2 * size
    start, size = at, CHUNK
    while start > low:
        stop = max(start - size, low)
        off = np.flatnonzero(codes[stop:start] != codes[stop + p : start + p])
        if len(off):
            start = stop + int(off[-1]) + 1
            break
        start, size = stop, 2 * size
    return start, to


def runs(codes: np.ndarray, bounds: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of every maximal stretch of smallest period p and at least max(least, times * p) words, times
    being 3 or more, that lies in one of the texts with these bounds (one more than texts, longest text first)."""
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    lengths = np.diff(bounds)
    reach, period = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)
    for p in range(1, int(lengths.max(initial=0)) // times + 1):
        texts = int(np.searchsorted(-lengths, -max(least, times * p), "right"))
        stop = int(bounds[texts])
        if stop < 2 * p:
            break
        grid = codes[:stop:p]
        same = np.zeros(len(grid), bool)
        same[:-1] = grid[:-1] == grid[1:]
        points = np.flatnonzero(same[:-1] & same[1:]) * p
        for step in {1, p // 2, p - 1} - {0} if p > 1 else ():
            points = points[codes[points + step] == codes[points + step + p]]
        if not len(points):
            continue
        points = points[~((p % period[points] == 0) & (reach[points] > points + p))]
        done = -1
        for at in points.tolist():
            if at < done:
                continue
            if p % period[at] == 0 and reach[at] > at + p:
                continue
            text = int(np.searchsorted(bounds, at, "right")) - 1
            low, high = int(bounds[text]), int(bounds[text + 1])
            if at + p >= high or codes[at] != codes[at + p]:
                continue
            start, to = _agree(codes, at, p, low, high)
            done, end = to, to + p
            if end - start < max(least, times * p) or (start, end) in known:
                continue
            known.add((start, end))
            found.append((start, end, p))
            farther = np.flatnonzero(reach[start:end] < end) + start
            reach[farther], period[farther] = end, p
    return found


def _best(own: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as fractions; ties: the smallest start, then period."""
    best = None
    for start, length, p in own:
        if best is None or length * best[2] > best[1] * p or (length * best[2] == best[1] * p and (start, p) < (best[0], best[2])):
            best = (start, length, p)
    return best


def _joined(words: pa.Array, counts: np.ndarray) -> list[bytes]:
    """The words of each row (counts of them) joined by one space."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    sizes = np.diff(offsets) if len(words) else np.zeros(0, np.int64)
    out = np.full(len(raw) + len(words), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), sizes)] = raw
    stops = np.append(0, np.cumsum(sizes + 1))[np.append(0, np.cumsum(counts))]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _collapsed(ids: pa.Array, data: np.ndarray, ends: np.ndarray, least: int, times: int, rewrite: Rewrite | None) -> list[tuple]:
    words, bounds = _words(data, ends)
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    place = np.repeat(bounds[:-1][order], counts[order]) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
    if rewrite is not None:
        ask = np.flatnonzero((counts > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
        start, period = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        start[ask], period[ask] = rewrite(ids.take(pa.array(ask)).to_numpy(), counts[ask])
        a = np.repeat((bounds[:-1] + start)[order], counts[order])
        p = np.repeat(period[order], counts[order])
        place = np.where((p > 0) & (place >= a), a + (place - a) % np.maximum(p, 1), place)
    laid = np.append(0, np.cumsum(counts[order]))
    codes = words.dictionary_encode().indices.to_numpy()[place] if len(words) else np.zeros(0, np.int32)
    keep = np.ones(len(codes), bool)
    own: list[list[tuple[int, int, int]]] = [[] for _ in order]
    for start, end, p in runs(codes, laid, least, times):
        keep[start + p : end] = False
        text = int(np.searchsorted(laid, start, "right")) - 1
        own[text].append((start - int(laid[text]), end - start, p))
    kept = np.diff(np.append(0, np.cumsum(keep))[laid])
    texts = _joined(words.take(pa.array(place[keep])), kept)
    out: list[tuple] = [()] * len(order)
    for k, row in enumerate(order.tolist()):
        listed = sorted((s, p, n) for s, n, p in own[k])
        said = "".join(f"{s},{n},{p}\n" for s, p, n in listed)
        start, length, p = _best(own[k]) or (None, None, None)
        out[row] = (len(own[k]), start, length, p, None if p is None else 1000 * length // p, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(texts[k]).hexdigest())
    return out


def _scan(batches: Iterator[pa.RecordBatch], least: int, times: int, rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, SLICE):
            rows = _collapsed(batch.column("doc_id").slice(a, b - a), data, ends[a : b + 1], least, times, rewrite)
            kinds = [*(pa.int64(),) * 5, pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=[x.split()[0] for x in _OUT.split(", ")])


def planted(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A period for each text whose crc32 of the decimal id is divisible by 10: from word a on the text repeats three times
    or more."""
    h = np.fromiter((zlib.crc32(b"%d" % x) for x in ids.tolist()), np.int64, len(ids))
    g = h // 10
    a = g % n
    return a, np.where(h % 10 == 0, 1 + (n - a) // (3 + g % 8), 0)


def periodic_runs(docs: DataFrame, *, least_words: int = 24, least_times: int = 3, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of docs (doc_id,
    text; other columns are ignored), from the whole text.

    Words are runs of bytes outside space and \\t..\\r, compared as they are. A run is a maximal stretch of words of smallest
    period p and at least max(least_words, least_times * p) words (least_times is 3 or more). start, length and period are
    those of the run of greatest length / period; null without a run. A word is dropped if a run holds it after the run's
    first p words; collapsed_sha256 is of the others, joined by one space. rewrite: makes texts repeat before they are
    searched; it isn't asked for texts without an id or words. Null and empty texts have no words and no runs; repeated rows
    are searched each. Each text is handled by itself.
    """
    if least_times < 3:
        raise ValueError("the grid finds runs of three periods or more")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(own, lambda b: _scan(b, least_words, least_times, rewrite), _OUT)
