"""Token counts by offset-mapped attribution.

Whole documents are encoded once, each token with the span of characters that it stands for; an interval join gives
every token to the section (or field) that its span meets. A token that crosses a boundary is allocated by a rule.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import buffers, in_arrow, slices
from .units import SLICE, Units, added_strings, unit_spans

_units: dict[str, Units] = {}
#: Where a token that crosses a boundary counts: in the section of its first character, of its last, or of the most of
#: its characters (the first of equals).
RULES = ("start", "end", "most")


def _spans(path: str) -> Units:
    if path not in _units:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        _units[path] = Units(lambda units: unit_spans(tokenizer, units), np.zeros((0, 2), np.int32), most=200_000, whole=added_strings(tokenizer))
    return _units[path]


def line_sections(raw: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with offsets own into raw: the row and the first byte of each line (a line has its \\n)."""
    breaks = np.flatnonzero(raw == 0x0A)
    row = np.concatenate([np.arange(len(own) - 1), np.searchsorted(own, breaks, "right") - 1])
    start = np.concatenate([own[:-1], breaks + 1])
    order = np.lexsort((start, row))
    return row[order], start[order]


def allocate(spans: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that cross its boundary. row: of each token; starts, ends: of each
    section; before: of each row its first section (one more than rows)."""
    low, high = before[row], before[row + 1] - 1
    first = np.clip(np.searchsorted(starts, spans[:, 0], "right") - 1, low, high)
    last = np.clip(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, low, high)
    crossing, to = last > first, first.copy()
    if rule == "end":
        to = last
    elif rule == "most":
        for k in np.flatnonzero(crossing):
            own = slice(first[k], last[k] + 1)
            to[k] = first[k] + int(np.argmax(np.minimum(ends[own], spans[k, 1]) - np.maximum(starts[own], spans[k, 0])))
    return np.bincount(to, minlength=len(starts)), np.bincount(to[crossing], minlength=len(starts))


def _counts(batches: Iterator[pa.RecordBatch], path: str, rule: str) -> Iterator[pa.RecordBatch]:
    units = _spans(path)
    for batch in batches:
        docs = batch.column("doc_id")
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, SLICE):
            own = ends[a : b + 1] - ends[a]
            raw = data[int(ends[a]) : int(ends[b])]
            spans, counts, sizes, begins = units.values(data, ends[a : b + 1])
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
            spans = spans + np.repeat(chars[begins], sizes)[:, None]
            section_row, first = line_sections(raw, own)
            before = np.searchsorted(section_row, np.arange(b - a + 1))
            starts = chars[first]
            stops = np.append(starts[1:], 0)
            stops[before[1:] - 1] = chars[own[1:]]
            n, crossing = allocate(spans, np.repeat(np.arange(b - a), counts), starts, stops, before, rule)
            zero = chars[own[:-1]][section_row]
            columns = (np.arange(len(first)) - before[section_row], starts - zero, stops - zero, n, crossing)
            yield pa.RecordBatch.from_arrays([docs.slice(a, b - a).take(pa.array(section_row)), *(pa.array(x.astype(np.int64)) for x in columns)], names=["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing"])


def section_tokens(docs: DataFrame, tokenizer: str, *, rule: str = "start") -> DataFrame:
    """(doc_id, section, first_char, end_char, n_tokens, n_crossing) of each line of each text of docs (doc_id, text).

    Characters are code points, a line includes its \\n, sections count from 0; n_tokens adds up to the document's tokens
    whatever the rule (one of RULES), n_crossing are those that reach into another section. A null or empty text is one
    empty section. Repeated rows give repeated results; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(docs, lambda b: _counts(b, tokenizer, rule), "doc_id long, section long, first_char long, end_char long, n_tokens long, n_crossing long")
