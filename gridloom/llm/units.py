"""Texts cut where a byte-level pattern always cuts too, and a bounded table of what the cuts give.

The patterns of byte-level vocabularies take runs of letters, of digits or of other signs, each with at most one space in
front, and look ahead but never back. So a piece ends where a letter, digit or sign meets one of another kind or white
space, and a single space between two characters that are not white space begins a piece. Between such cuts a text is
encoded independently. The cuts are found on the bytes of many texts at once, the units are numbered by Arrow's
dictionary, and only units that are new to a task are encoded; the values of all units of a slice are then one gather
from a flat array.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Units that a worker remembers; beyond it a new generation begins, which takes over only what is used again.
MOST = 500_000
#: Bytes of text that are cut and looked up at once.
SLICE = 4 << 20
#: Kinds of bytes: white space, letters, digits, other ASCII signs, and the rest (controls and longer characters).
_WHITE, _LETTER, _DIGIT, _SIGN, _HIGH = range(5)
_KIND = np.full(256, _HIGH, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B] = _DIGIT, _LETTER, _LETTER
#: Whether a kind in front of another is the end of a piece. An apostrophe may belong to what follows.
_ENDS = np.zeros((8, 8), bool)
_ENDS[[_LETTER, _DIGIT, _SIGN], _WHITE] = True
for _x in (_LETTER, _DIGIT, _SIGN):
    _ENDS[_x, [k for k in (_LETTER, _DIGIT, _SIGN) if k != _x]] = True
_ENDS = _ENDS.ravel()
#: First bytes of longer characters that are not white space (C2, E1, E2 and E3 begin some that are).
_NEXT = np.zeros(256, bool)
_NEXT[0x21:0x7F] = True
_NEXT[0xC3:0xF8] = True
_NEXT[[0xE1, 0xE2, 0xE3]] = False


def unit_starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin in data, from the first row's begin, and of each row the number of units before it (one more
    than rows). ends: row offsets into data. A row's first unit begins with the row."""
    first, last = int(ends[0]), int(ends[-1])
    raw = data[first:last]
    own = ends - first
    kind = _KIND[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[1 : len(raw)] = _ENDS[kind[:-1] << 3 | kind[1:]] & ((raw[:-1] != 0x27) | (kind[1:] == _WHITE))
    # A line break alone between two signs is a piece; so is a space alone the begin of one, beside longer characters too.
    at = np.flatnonzero(raw == 0x0A) + 1
    at = at[(at > 1) & (at < len(raw))]
    at = at[(kind[at - 2] != _WHITE) & (kind[at - 2] != _HIGH) & (kind[at] != _WHITE) & (kind[at] != _HIGH)]
    begins[at[~np.isin(at - 1, own)]] = True
    at = np.flatnonzero((raw[1:] == 0x20) & (kind[:-1] == _HIGH)) + 1
    at = at[at + 1 < len(raw)]
    at = at[_NEXT[raw[at + 1]] & ~np.isin(at + 1, own)]
    one, two, three = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    short = (two >= 0xC3) & (two <= 0xDF)
    long = ((two & 0xC0) == 0x80) & (((three & 0xC0) == 0x80) | (three == 0xE0) | (three >= 0xE4))
    begins[at[((one & 0xC0) == 0x80) & (short | long)]] = True
    begins[own] = True
    starts = np.flatnonzero(begins[: len(raw)])
    return starts, np.searchsorted(starts, own)


def numbered(data: np.ndarray, starts: np.ndarray, first: int, last: int) -> tuple[np.ndarray, pa.Array]:
    """The number of each unit in the list of distinct units (bytes), and that list."""
    offsets = pa.py_buffer(np.append(starts, last - first).astype(np.int32))
    units = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(data[first:last]))])
    found = units.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Runs:
    """Numbered runs of values: the k-th has sizes[k] entries from starts[k] on in a flat array."""

    def __init__(self, like: np.ndarray):
        self.flat, self.used = np.zeros((1 << 12, *like.shape[1:]), like.dtype), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of further runs, whose values follow each other in flat."""
        n, k, more = len(flat), self.count, len(sizes)
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros((max(n, self.used), *self.flat.shape[1:]), self.flat.dtype)])
        if k + more > len(self.starts):
            room = np.zeros(max(more, k), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts[:k], room]), np.concatenate([self.sizes[:k], room])
        self.flat[self.used : self.used + n] = flat
        self.sizes[k : k + more] = sizes
        self.starts[k : k + more] = self.used + np.cumsum(sizes) - sizes
        self.used += n
        self.count += more
        return np.arange(k, k + more)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the runs with these numbers one after another, and how many each has."""
        starts, sizes = self.starts[codes], self.sizes[codes]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Table(Runs):
    """Runs by key (bytes)."""

    def __init__(self, like: np.ndarray):
        super().__init__(like)
        self.known: dict[bytes, int] = {}

    def add(self, keys: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        codes = self.extend(flat, sizes)
        self.known.update(zip(keys, codes.tolist(), strict=True))
        return codes

    def codes(self, keys: list[bytes]) -> np.ndarray:
        """The keys' numbers, -1 for others."""
        return np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))


class Units:
    """Values of units, computed for new units only by of(list of units) -> (flat values, number of each).

    When the table is full it becomes the older of two generations; what is used again comes over from there, so that
    frequent units are never computed anew. A row that holds one of the strings in whole is a unit by itself.
    """

    def __init__(self, of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], like: np.ndarray, *, most: int = MOST, whole: tuple[bytes, ...] = ()):
        self.of, self.like, self.most, self.whole = of, like, most, whole
        self.young, self.older = Table(like), None

    def lookup(self, units: pa.Array) -> np.ndarray:
        """The numbers of distinct units in the young table, where they all are afterwards."""
        if len(self.young.known) > self.most:
            self.young, self.older = Table(self.like), self.young
        keys = units.to_pylist()
        codes = self.young.codes(keys)
        new = np.flatnonzero(codes < 0)
        if self.older is not None and len(new):
            old = self.older.codes([keys[k] for k in new])
            back = new[old >= 0]
            codes[back] = self.young.add([keys[k] for k in back], *self.older.gather(old[old >= 0]))
            new = new[old < 0]
        if len(new):
            fresh = [keys[k] for k in new]
            codes[new] = self.young.add(fresh, *self.of(fresh))
        return codes

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, rows = unit_starts(data, ends)
        first = int(ends[0])
        raw = data[first : int(ends[-1])].tobytes() if self.whole else b""
        if not any(x in raw for x in self.whole):
            return starts, rows
        own = (ends - first).tolist()
        held = [any(x in raw[a:b] for x in self.whole) for a, b in zip(own[:-1], own[1:], strict=True)]
        of = np.repeat(np.arange(len(held)), np.diff(rows))
        starts = starts[~np.array(held)[of] | np.isin(starts, own)]
        return starts, np.searchsorted(starts, own)

    def values(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of data with these offsets: all values one after another, how many each row has, how many each
        unit has, and where the units begin."""
        starts, rows = self._starts(data, ends)
        if not len(starts):
            return self.like[:0], np.zeros(len(ends) - 1, np.int64), np.zeros(0, np.int64), starts
        index, distinct = numbered(data, starts, int(ends[0]), int(ends[-1]))
        codes = self.lookup(distinct)[index]
        flat, sizes = self.young.gather(codes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(total[rows]), sizes, starts


#: Units that are encoded by one call.
CALL = 10_000


def unit_ids(tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units one after another, and how many each has."""
    found = []
    for k in range(0, len(units), CALL):
        found += [one.ids for one in tokenizer.encode_batch_fast([u.decode("utf-8") for u in units[k : k + CALL]], add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def unit_spans(tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first and end character of each token of units one after another, and how many tokens each has."""
    found = []
    for k in range(0, len(units), CALL):
        found += [one.offsets for one in tokenizer.encode_batch([u.decode("utf-8") for u in units[k : k + CALL]], add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, 2 * int(sizes.sum())).reshape(-1, 2), sizes


def added_strings(tokenizer) -> tuple[bytes, ...]:
    """The strings that the tokenizer finds in a text before it cuts it."""
    return tuple(sorted({t.content.encode("utf-8") for t in tokenizer.get_added_tokens_decoder().values()}))
