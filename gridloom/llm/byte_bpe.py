"""Byte-level BPE by folding ranked merges with Spark's higher-order functions, and decoding by binary pieces.

Words that a bounded sample of documents repeats are folded once ahead and sent to every task; they only spare work. For
all other words there are three narrow steps without a shuffle: (1) each task splits its texts by the pattern, numbers the words and sends every
word that it has not sent before, as a byte array, ahead of the documents that use it, which it sends as word numbers;
(2) Spark folds the ranked merges over the byte arrays, looking pairs up in a literal rank map (all mergeable pairs, in
literal arrays with one place for each pair); (3) documents are put together from their words' ids, a gather from flat
arrays, and the ids are decoded by concatenating the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, freed, in_arrow, materialize, release, slices
from .units import Runs, Units

#: Words in a row of step 1.
CHUNK = 1000
#: Words and units that a task remembers, and bytes of the words; beyond either it forgets all and sends words anew, so that
#: memory is bounded (about 90 MB in step 1, a fifth of it in step 3).
REMEMBERED, REMEMBERED_BYTES = 400_000, 20 << 20
#: Documents, about, of the sample whose repeated words are folded ahead, the most of these words, and the bytes of the
#: longest; they bound what is sent to the tasks (some MB).
SAMPLE, SENT, SENT_BYTES = 10_000, 100_000, 64
#: Bytes of text that are split at once, and of word numbers that are put together at once.
PART, NUMBERS = 1 << 20, 512 << 10


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def mergeable(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of every pair of tokens whose bytes together are a token."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


#: Ranks from here on say that a pair doesn't merge.
_NEVER = 1 << 16
#: Bits of an id in the fold's state, where the rank begins there, and the least state of a pair that doesn't merge.
_ID_BITS, _RANK_AT = 16, 46
_DONE = _NEVER << _RANK_AT


@lru_cache(2)
def _tables(path: str) -> tuple[str, str, str, str]:
    """The rank map as JSON arrays: for each left id a shift, the slots (left id plus one and merged id in one number, 0 in
    an unused slot), the rank of each byte with the next one (256 at the end of a word), and each byte's id.

    The pair (a, b) is at shift[a] + b; rows are laid over each other, the largest first, where they don't collide. The id
    after the last one stands for an edge: it merges with nothing. The numbers are short because Spark keeps the plan's
    text, with its literals, for each query that ran.
    """
    ranks = read_ranks(path)
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), token in (pairs := mergeable(ranks)).items():
        rows.setdefault(a, []).append((b, token))
    used, shifts = np.zeros(1 << 21, bool), [0] * (max(ranks.values()) + 1)
    slots, low = np.zeros(len(used), np.int64), 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array([b for b, _ in row])
        first, shift, start = int(rights.min()), None, low
        while shift is None and start < len(used):
            tries = start + np.flatnonzero(~used[start : start + 4096]) - first
            tries = tries[(tries >= 0) & (tries + int(rights.max()) < len(used))]
            for right in rights:
                tries = tries[~used[tries + right]]
            shift, start = int(tries[0]) if len(tries) else None, start + 4096
        if shift is None:
            raise ValueError("the slots are too few")
        shifts[a] = shift
        used[shift + rights] = True
        slots[shift + rights] = [(a + 1) << _ID_BITS | token for _, token in row]
        while used[low]:
            low += 1
    last = int(np.flatnonzero(used)[-1])
    shifts.append(last + 1)
    one = [ranks[bytes([b])] for b in range(256)]
    firsts = [pairs.get((a, b), _NEVER) for a in one for b in [*one, -1]]
    slots = slots[: last + 2 * len(shifts) + 1].tolist()
    return tuple(json.dumps(x, separators=(",", ":")) for x in (shifts, slots, firsts, one))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_encoded(words: Column, path: str) -> Column:
    """An array of byte arrays (ints 0 to 255) as their token ids by the ranks of path; the literal tables are in the
    plan once."""
    names = ("shifts", "slots", "firsts", "ids")
    tables = F.struct(*(F.from_json(F.lit(x), "array<bigint>").alias(name) for name, x in zip(names, _tables(path), strict=True)))
    edge = len(_tables(path)[0].split(",")) - 1
    return _let(tables, lambda t: F.transform(words, _word_encoder(*(t[name] for name in names), edge)))


def _word_encoder(shifts: Column, slots: Column, firsts: Column, ids: Column, last: int) -> Callable[[Column], Column]:
    """A function of a byte array that gives its token ids.

    The fold's state is one array: a number for each token, with an edge at both ends, of its rank with the next token
    (upper bits), the place of its first byte (30 bits) and its id (16 bits). So the least number is the pair of least
    rank, the leftmost of equals. A step merges that pair and looks its two new neighbours up; once no pair merges it
    changes nothing.
    """

    def token(x: Column) -> Column:
        return x.bitwiseAND((1 << _ID_BITS) - 1)

    def rank(left: Column, right: Column) -> Column:
        """The merged id, which is the rank, in its place in the state; _NEVER where the slot is another left id's."""
        found = F.get(slots, (F.get(shifts, left.cast("int")) + right).cast("int")).bitwiseXOR(F.shiftleft(left + 1, _ID_BITS))
        return F.shiftleft(F.least(found, F.lit(_NEVER).cast("bigint")), _RANK_AT)

    def place(x: Column) -> Column:
        return x.bitwiseAND((1 << _RANK_AT) - (1 << _ID_BITS))

    def merged(state: Column, pair: Column, at: Column) -> Column:
        """at: place of the pair in state from 0."""
        best, before = F.shiftright(pair, _RANK_AT), F.get(state, at - 1)
        new_pair = rank(best, token(F.get(state, at + 2))).bitwiseOR(place(pair)).bitwiseOR(best)
        new_before = rank(token(before), best).bitwiseOR(before.bitwiseAND((1 << _RANK_AT) - 1))
        return F.flatten(F.array(F.slice(state, F.lit(1), at - 1), F.array(new_before, new_pair), F.slice(state, at + 3, F.size(state))))

    def at(state: Column, pair: Column) -> Column:
        return F.array_max(F.transform(state, lambda x, i: F.when(x == pair, i)))

    def step(state: Column, _: Column) -> Column:
        """Folds over one value each, which name it without copying the state as transform would."""
        def on_pair(now: Column, pair: Column) -> Column:
            return F.when(pair >= _DONE, now).otherwise(F.aggregate(F.array(at(now, pair)), now, lambda s, i: merged(s, pair, i)))

        return F.aggregate(F.array(F.array_min(state)), state, on_pair)

    def encode(word: Column) -> Column:
        def first(b: Column, i: Column) -> Column:
            pair = F.get(firsts, b * 257 + F.coalesce(F.get(word, i + 1), F.lit(256)))
            return F.shiftleft(pair, _RANK_AT).bitwiseOR(F.shiftleft((i + 1).cast("bigint"), _ID_BITS)).bitwiseOR(F.get(ids, b))

        numbers = F.transform(word, first)
        start = F.concat(F.array(F.lit(_DONE + last)), numbers, F.array(F.lit(2 * _DONE - (1 << _ID_BITS) + last)))
        return F.aggregate(F.slice(word, F.lit(1), F.size(word) - 1), start, step, lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), token))

    return encode


class _Words:
    """Numbers the words of units by the pattern, and keeps those that were not sent yet."""

    def __init__(self, pattern: str, most: int, ahead: list[bytes]):
        self.pattern, self.most, self.ahead = regex.compile(pattern), most, ahead
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = dict(zip(self.ahead, range(len(self.ahead)), strict=True))
        self.new: list[bytes] = []
        self.size = 0
        self.units = Units(self._split, np.zeros(0, np.int32), most=1 << 62)

    def full(self) -> bool:
        return max(len(self.known) - len(self.ahead), len(self.units.young.known)) > self.most or self.size > REMEMBERED_BYTES

    def _split(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers, sizes, known = [], [], self.known
        for unit in units:
            words = self.pattern.findall(text := unit.decode("utf-8"))
            sizes.append(len(words))
            for word in [unit] if words == [text] else [w.encode("utf-8") for w in words]:
                if (number := known.get(word)) is None:
                    known[word] = number = len(known)
                    self.new.append(word)
                    self.size += len(word)
                numbers.append(number)
            self.size += len(unit)
        return np.array(numbers, np.int32), np.array(sizes, np.int64)

    def take(self) -> list[bytes]:
        new, self.new = self.new, []
        return new


def _nested(rows: list[list[bytes]]) -> pa.Array:
    flat = b"".join(w for row in rows for w in row)
    inner = np.cumsum([0, *(len(w) for row in rows for w in row)])
    outer = np.cumsum([0, *(len(row) for row in rows)])
    words = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.frombuffer(flat, np.uint8).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), words)


_WORD_ROWS = pa.list_(pa.list_(pa.int32()))


def _binary(flat: np.ndarray, stops: np.ndarray) -> pa.Array:
    """A binary column of the bytes of flat up to each of stops (in bytes)."""
    kind = pa.binary() if not len(stops) or stops[-1] < 1 << 31 else pa.large_binary()
    offsets = np.append(0, stops).astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


@dataclass
class Ahead:
    """Words that are folded ahead, their ids one after another, and how many each has."""

    words: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch], pattern: str, most: int) -> Iterator[pa.RecordBatch]:
    """How often the words of a task's texts occur."""
    words = _Words(pattern, most, [])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words.known), pa.binary()), pa.array(counts[: len(words.known)])], names=["word", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, PART):
            if words.full():
                yield out()
                words.clear()
                counts[:] = 0
            numbers = words.units.values(data, ends[a : b + 1])[0]
            if len(words.known) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(words.known), np.int64)])
            np.add.at(counts, numbers, 1)
    if words.known:
        yield out()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("word").to_pylist()
        rows = [own[k : k + CHUNK] for k in range(0, len(own), CHUNK)]
        yield pa.RecordBatch.from_arrays([_nested(rows).cast(_WORD_ROWS)], names=["words"])


def folded_ahead(docs: DataFrame, ranks_path: str, pattern: str) -> Ahead:
    """Words that occur three times or more in a sample of about SAMPLE documents of docs (text), with their ids."""
    texts = docs.select("text")
    texts = texts.sample(min(1.0, SAMPLE / max(1, texts.count())), seed=5)
    counts = in_arrow(texts, lambda b, most=REMEMBERED: _word_counts(b, pattern, most), "word binary, n long")
    twice = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > 2).where(F.length("word") <= SENT_BYTES).orderBy(F.desc("n"), "word").limit(SENT).select("word"), "words")
    rows = in_arrow(twice, _word_rows, "words array<array<int>>")
    found = rows.select("words", words_encoded(F.col("words"), ranks_path).cast("array<array<int>>").alias("ids")).toArrow()  # of a bounded sample
    release(twice)
    words: list[bytes] = []
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for chunk in found.to_batches():
        one, two = chunk.column("words").flatten(), chunk.column("ids").flatten()
        raw, cuts = one.flatten().to_numpy().astype(np.uint8).tobytes(), np.append(0, np.cumsum(one.value_lengths().to_numpy())).tolist()
        words += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids.append(two.flatten().to_numpy().astype(np.uint32))
        sizes.append(two.value_lengths().to_numpy().astype(np.int64))
    del found
    out = Ahead(words, np.concatenate(ids), np.concatenate(sizes))
    freed()
    return out


def _known(ahead: Ahead) -> Runs:
    out = Runs(np.zeros(0, np.uint32))
    out.extend(ahead.ids, ahead.sizes)
    return out


def _split(batches: Iterator[pa.RecordBatch], pattern: str, names: list[str], most: int, ahead: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of new words ahead of the rows of documents that use them; an empty list of words says to forget the others."""
    words = _Words(pattern, most, ahead)
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, PART):
            rows: list[list[bytes]] = []
            if words.full():
                words.clear()
                rows.append([])
            numbers, counts, _, _ = words.units.values(data, ends[a : b + 1])
            new = words.take()
            rows += [new[k : k + CHUNK] for k in range(0, len(new), CHUNK)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), batch.schema.field(x).type) for x in names] + [_nested(rows).cast(_WORD_ROWS), pa.nulls(len(rows), pa.binary())], names=[*names, "words__", "numbers__"])
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(x) for x in names] + [pa.nulls(b - a, _WORD_ROWS), _binary(numbers, 4 * np.cumsum(counts))], names=[*names, "words__", "numbers__"])


def _assemble(batches: Iterator[pa.RecordBatch], names: list[str], pieces: pa.Array, ahead: Ahead) -> Iterator[pa.RecordBatch]:
    """The documents with their ids and decoded bytes, from the words met before them."""
    known = _known(ahead)
    for batch in batches:
        words, ids = batch.column("words__"), batch.column("ids__")
        is_words = words.is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(is_words)) + 1
        for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(is_words)).tolist(), strict=True):
            if b <= a:
                continue
            if is_words[a]:
                for k in range(a, b):
                    if not len(words[k].values):
                        known = _known(ahead)
                        continue
                    own = ids[k].values
                    known.extend(own.flatten().to_numpy(), own.value_lengths().to_numpy())
                continue
            ends, data = buffers(batch.column("numbers__").slice(a, b - a))
            for x, y in slices(ends, NUMBERS):
                numbers = data[int(ends[x]) : int(ends[y])].view(np.int32)
                found, sizes = known.gather(numbers)
                stops = np.append(0, np.cumsum(sizes))[(ends[x + 1 : y + 1] - ends[x]) // 4]
                decoded = pieces.take(pa.array(found.view(np.int32)))
                at, text = buffers(decoded)
                text, cuts = text[int(at[0]) : int(at[-1])], (at - at[0])[stops]
                raw, plain = memoryview(found.astype("<u4")).cast("B"), memoryview(text)
                sums = [[hashlib.sha256(view[i:j]).hexdigest() for i, j in zip([0, *to[:-1]], to, strict=True)] for view, to in ((raw, (4 * stops).tolist()), (plain, cuts.tolist()))]
                part = batch.slice(a + x, y - x)
                extra = [pa.array(np.diff(stops, prepend=0)), *(pa.array(one, pa.string()) for one in sums)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [_binary(found.astype("<u4"), 4 * stops), _binary(text, cuts), *extra], names=[*names, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"])


def _narrowed(batches: Iterator[pa.RecordBatch], drop: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(drop)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, streams: tuple[str, ...] = ("ids", "decoded"), ahead: bool = True, remembered: int | None = None) -> DataFrame:
    """docs (text, any others) with, in place of text: ids (the tokens as little-endian unsigned 32-bit words), decoded
    (the bytes that they stand for; only those named in streams), n_tokens, ids_sha256 and decoded_sha256.

    Each match of pattern is encoded by itself, as the rank file's own library does, without special tokens. A null text
    is empty: no tokens and no bytes. Columns by the names of the results are replaced. A word of many thousand bytes is
    folded in quadratic time. ahead=False leaves the words of the sample to the tasks: more work for them, but one plan with
    the literal tables less for the driver to hold. remembered: words that a task remembers, in place of REMEMBERED.
    """
    results = ["ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*results, "words__", "numbers__", "ids__").withColumn("text", F.col("text").cast("string"))
    fields = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in fields]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pieces = pa.array(tokens, pa.binary())
    none = Ahead([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
    held = docs.sparkSession.sparkContext.broadcast(folded_ahead(docs, ranks_path, pattern) if ahead else none)
    split = in_arrow(docs, lambda b, most=remembered or REMEMBERED: _split(b, pattern, names, most, held.value.words), f"{kinds}words__ array<array<int>>, numbers__ binary")
    coded = split.withColumn("ids__", F.when(F.col("words__").isNotNull(), words_encoded(F.col("words__"), ranks_path).cast("array<array<int>>")))
    drop = [x for x in ("ids", "decoded") if x not in streams]
    schema = kinds + "".join(f"{x} binary, " for x in ("ids", "decoded") if x in streams) + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_arrow(coded, lambda b: _narrowed(_assemble(b, names, pieces, held.value), drop), schema)
