"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: in any occurrence within the budget one piece at
least is unchanged. All pieces go into one Aho-Corasick automaton; each exact hit fixes where the item would lie, and
Myers' bit-parallel distance verifies the item against that stretch of the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow

#: Characters of item text in one automaton. More items go in further passes over the documents, so that what is
#: sent to executors is bounded.
BLOCK_CHARS = 4 << 20
#: The automaton of the last block that a worker met, by a hash of the block's items and rate.
_built: dict[str, ahocorasick.Automaton] = {}


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    """Edits that an occurrence of the item may have."""
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near-equal length with their offsets."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def edit_distance_within(item: str, text: str) -> int:
    """The least edit distance of item to any substring of text (Myers' bit-parallel search)."""
    m = len(item)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for j, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << j
    mask, high = (1 << m) - 1, 1 << m - 1
    up, down, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        across = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        right = down | (~(diagonal | up) & mask)
        left = up & diagonal
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right = right << 1 & mask
        left = left << 1 & mask
        up = left | (~(across | right) & mask)
        down = right & across
        best = min(best, score)
    return best


def _automaton(items: list[tuple[int, str]], rate: float) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for n, (_, item) in enumerate(items):
        for at, piece in pieces(item, budget(item, rate)):
            found.setdefault(piece, []).append((n, at))
    out = ahocorasick.Automaton()
    for piece, where in found.items():
        out.add_word(piece, (len(piece), where))
    if found:
        out.make_automaton()
    return out


def matches(text: str, items: list[tuple[int, str]], automaton: ahocorasick.Automaton, rate: float) -> dict[int, int]:
    """The items (by position) within their budget somewhere in the normalised text, with the least distance."""
    places: dict[int, set[int]] = {}
    for end, (length, where) in automaton.iter(text):
        for n, at in where:
            places.setdefault(n, set()).add(end + 1 - length - at)
    out: dict[int, int] = {}
    for n, starts in places.items():
        item = items[n][1]
        k = budget(item, rate)
        if item in text:
            out[n] = 0
            continue
        run: list[int] = []
        spans = []
        for start in sorted(starts):  # starts close to each other share one stretch
            if run and start - run[-1] > 2 * k + 1:
                spans.append((run[0], run[-1]))
                run = []
            run.append(start)
        spans.append((run[0], run[-1]))
        best = min(edit_distance_within(item, text[max(0, a - k) : b + len(item) + k]) for a, b in spans)
        if best <= k:
            out[n] = best
    return out


def content_key(items: list[tuple[int, str]], rate: float) -> str:
    """A name for a block of items and a rate that no other block has."""
    return hashlib.sha256(repr((rate, items)).encode("utf-8", "surrogatepass")).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch], held, key: str, rate: float) -> Iterator[pa.RecordBatch]:
    items = held.value
    if key not in _built:
        _built.clear()
        _built[key] = _automaton(items, rate)
    automaton = _built[key]
    for batch in batches:
        doc, item, edits = [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for n, k in matches(normal(text), items, automaton, rate).items():
                doc.append(d)
                item.append(items[n][0])
                edits.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, item, edits)], names=["doc_id", "item_id", "edits"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.06) -> DataFrame:
    """(doc_id, item_id, edits): the items of benchmark (item_id, text) that a text of docs (doc_id, text) contains
    within rate edits a character, after lower-casing and white space folding, with the least number of edits.

    Empty or null items match nothing, empty or null texts hold nothing; repeated rows give repeated results; other
    columns are ignored. The items are a stated query set; they are read in blocks of BLOCK_CHARS.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if not (item := normal(row["text"])):
            continue
        if size + len(item) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row["item_id"], item))
        size += len(item)
    out = None
    for block in blocks:
        held = spark.sparkContext.broadcast(block)
        key = content_key(block, rate)
        found = in_arrow(docs, lambda b, held=held, key=key: _scan(b, held, key, rate), "doc_id long, item_id long, edits long") if block else spark.createDataFrame([], "doc_id long, item_id long, edits long")
        out = found if out is None else out.unionAll(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.06) -> DataFrame:
    """docs without the documents that hold an item of benchmark; all columns stay, rows without an id stay."""
    hit = benchmark_matches(docs, benchmark, rate=rate).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
