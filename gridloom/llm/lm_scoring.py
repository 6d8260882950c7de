"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context of up to DEPTH words. A context is a candidate if it was met LEAST times, its suffix is in
the tree and the context without its last word is a candidate too (so a long context is only found by way of its suffixes); a next word is kept if its count
exceeds what the suffix's distribution expects by a deviance of NEXT nats; a context is retained if its kept next words
diverge from the suffix's distribution: if predicting each token after it from the others after it gains GAIN nats or more.
The next-word distribution of a state is discounted: DISCOUNT of each kept count and all other counts go to its suffix's
distribution, down to the root, the add-half unigram. A token is scored by the longest state that its history ends with.

With log P along a chain of suffixes c1, c2, ... the score is a sum of terms that belong to single grams: log P0(w) of each
word, the back-off weight of each retained context, and for each gram that was found a gain over what the shorter chain
gives. So scoring needs no order of lookups: grams are 64-bit keys with one value each. The most frequent keys go to every
task (a fixed number of them), which takes hot keys out of the shuffle. For the others a chunk of texts sends to each bucket of
keys one array of those that a filter of the model's keys holds, and the texts (by their places in the chunk) that have them;
the bucket answers with one array of sums for those texts. So an answer is no longer than what was asked. The RANKED most
frequent words are numbered, and a gram of up to three of them is their numbers side by side: such keys compress in a shuffle.
Any other gram is a hash.

Counts go from task to task in arrays: a task sums its grams, deals them to buckets by a hash, and sends an array of each
bucket's rows. There are as many buckets as keep one at about BUCKET training tokens, so that a bucket is bounded whatever the
data; grams that one text alone holds never become rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, hashed_words, in_arrow, materialize, mix, release, slices
from .filters import bits_for, key_filter, may_hold

#: Words of the longest context, and how often a context has to be met to be a candidate.
DEPTH, LEAST = 2, 16
#: What is taken from each kept count, and the nats that a kept next word and a retained context have to gain.
DISCOUNT, NEXT, GAIN = 0.75, 6.0, 4.0
#: Grams and words whose values go to every task, and words that are numbered, at most.
FREQUENT, FREQUENT_WORDS, RANKED = 1 << 20, 1 << 17, (1 << 16) - 2
#: States (32 bytes each) up to which they are sent to every task; more are joined by a shuffle.
SMALL = 400_000
#: Bytes of text whose tokens a task looks at once, and counted or asked grams that it holds before it sends them.
SLICE, HELD = 1 << 20, 1_000_000
#: Rows of a batch that is sent, training tokens for each bucket of counts, and keys for each bucket of the model.
ROWS, BUCKET, KEYS = 1 << 16, 1 << 20, 1 << 17
#: The token that ends a text.
END = np.uint64(0xE7D1A5C3B8F60429)
#: Set in the keys that are hashes; and the number of END if it is not among the most frequent words.
_HASH, _END_RANK = np.uint64(1 << 63), np.uint64((1 << 16) - 1)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class SuffixTree:
    """tokens, distinct: of the training texts; ranks: numbered words in order and their numbers; words, grams: frequent keys in
    order with base (of words) and value; others (gram, base, value): one row for each other key, base being null for grams of
    several words; filled: a filter of the others; buckets: that the others are dealt to."""

    others: DataFrame
    buckets: int
    tokens: int
    distinct: int
    ranks: Broadcast
    words: Broadcast
    grams: Broadcast
    filled: Broadcast

    @property
    def unknown(self) -> float:
        """log10 of the root's probability of a word that was never met."""
        return math.log10(0.5 / (self.tokens + 0.5 * (self.distinct + 1)))


def _joint(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The key of the gram whose words but the last are one gram and whose words but the first are another."""
    numbers = (context < np.uint64(1 << 32)) & (suffix < np.uint64(1 << 32))
    beside = context << np.uint64(16) | suffix & np.uint64(0xFFFF)
    return np.where(numbers, beside, mix(context * _LEFT + suffix * _RIGHT) | _HASH)


def _numbered(words: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Words as their numbers, or as hashes."""
    known, numbers = ranks
    distinct, back = np.unique(words, return_inverse=True)
    k = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return np.where(known[k] == distinct, numbers[k], distinct | _HASH)[back]


def _tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and of its end, and where each row's tokens begin (one more than rows)."""
    words, bounds = hashed_words(data, ends)
    rows = len(bounds) - 1
    out = np.full(len(words) + rows, END)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    out[np.arange(len(words)) + of] = words
    return out, bounds + np.arange(rows + 1)


def _grams(tokens: np.ndarray, bounds: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 on, the keys of the grams that end at each token, and whether the row has so many tokens."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = tokens
    for size in range(1, longest + 1):
        if size > 1:
            keys = np.append(np.uint64(0), _joint(keys[:-1], keys[1:]))
        yield keys, place >= size - 1


def _summed(context: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, with the sums of their counts."""
    order = np.lexsort((suffix, context))
    c, s = context[order], suffix[order]
    first = np.ones(len(order), bool)
    first[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(first)
    return c[at], s[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers of one length as planes of bytes, compressed: planes of small numbers and of runs vanish."""
    planes = np.concatenate([np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).ravel() for x in columns])
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=8 * n * len(kinds), codec="zstd"), np.uint8)
    return [np.array(planes[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T, order="C").view(kind).ravel() for k, kind in enumerate(kinds)]


def _steps(values: np.ndarray) -> np.ndarray:
    """What each number (unsigned) is more than the one before; np.cumsum gives the numbers back."""
    return np.diff(values, prepend=np.uint64(0))


def _shared(context: np.ndarray, depth: int) -> np.ndarray:
    """The words that a context of numbered words shares with its gram's suffix, where they stand in the suffix."""
    return (context & np.uint64((1 << 16 * (depth - 1)) - 1 if depth else 0)) << np.uint64(16)


def _pairs_packed(context: np.ndarray, suffix: np.ndarray, n: np.ndarray, depth: int) -> bytes:
    """Counted pairs in order of context and suffix."""
    own = suffix ^ _shared(context, depth)
    same = np.append(False, context[1:] == context[:-1])
    return _packed(_steps(context), own - np.where(same, np.append(np.uint64(0), own[:-1]), np.uint64(0)), n)


def _pairs_unpacked(data: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, more, n = _unpacked(data, np.uint64, np.uint64, np.int64)
    context, total = np.cumsum(steps, dtype=np.uint64), np.cumsum(more, dtype=np.uint64)
    at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    own = total - np.repeat((total - more)[at], np.diff(np.append(at, len(n))))
    return context, own ^ _shared(context, depth), n


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that have rows, and where they are, of rows in order of bucket."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for j in np.flatnonzero(np.diff(edges)):
        yield int(j), slice(edges[j], edges[j + 1])


class _Counts:
    """Counted pairs of keys; sent as one array for each bucket when they are many."""

    def __init__(self, buckets: int, depth: int):
        self.buckets, self.depth = buckets, depth
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, context: np.ndarray, suffix: np.ndarray) -> None:
        self.held.append(_summed(context, suffix, np.ones(len(suffix), np.int64)))
        self.size += len(self.held[-1][2])

    def whole(self) -> Iterator[pa.RecordBatch]:
        rows = _summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.size = [], 0
        # Numbered words that follow one context come to few buckets, where they compress; at most 2,048 of them to one.
        bucket = (mix(rows[0] * _RIGHT + (rows[1] >> np.uint64(11)) * _LEFT) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        c, s, n = (x[order] for x in rows)
        full = list(_by_bucket(bucket[order], self.buckets))
        for k in range(0, len(full), 64):
            sent = [_pairs_packed(c[own], s[own], n[own], self.depth) for _, own in full[k : k + 64]]
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in full[k : k + 64]], pa.int32()), pa.array(sent, pa.binary())], names=["bucket", "rows"])


def _added(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """(context, suffix, n) of the pairs of each bucket that were found least times, from batches in order of bucket."""
    held: list[bytes] = []
    now = None

    def whole() -> Iterator[pa.RecordBatch]:
        parts = [_pairs_unpacked(data, depth) for data in held]
        held.clear()
        c, s, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        often = n >= least
        c, s, n = c[often], s[often], n[often]
        for k in range(0, len(n), ROWS):
            own = slice(k, k + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c[own].view(np.int64)), pa.array(s[own].view(np.int64)), pa.array(n[own])], names=["context", "suffix", "n"])

    for batch in batches:
        for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if held and bucket != now:
                yield from whole()
            now = bucket
            held.append(rows.as_py())
    if held:
        yield from whole()


def _counts(docs: DataFrame, depth: int, least: int, tokens: int, ranks=None, filled=None) -> DataFrame:
    """(context, suffix, n): how often each gram of depth + 1 tokens is in docs (text), if least times or more, of about so many
    tokens."""
    buckets = max(1, -(-tokens // BUCKET))
    sent = in_arrow(docs.select("text"), lambda b: _counted(b, depth, buckets, ranks, filled), "bucket int, rows binary")
    return in_arrow(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), lambda b: _added(b, depth, least), "context long, suffix long, n long")


def _settled(df: DataFrame) -> DataFrame:
    """df, once the driver's JVM has noticed which shuffles nothing refers to any more; Spark deletes their files then."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _counted(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, ranks, filled) -> Iterator[pa.RecordBatch]:
    """The counts of grams of depth + 1 tokens by their two ends, by bucket; only after contexts that the filter may hold. Of
    single tokens the context is 0, and they are not numbered yet."""
    counts = _Counts(buckets, depth)
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        for a, b in slices(ends, SLICE):
            tokens, bounds = _tokens(data, ends[a : b + 1])
            grams = list(_grams(_numbered(tokens, ranks.value) if depth else tokens, bounds, depth + 1))
            keys, whole = grams[-1]
            at = np.flatnonzero(whole)
            if depth:
                ends_at = grams[-2][0]
                at = at[may_hold(filled.value, ends_at[at - 1])]
                counts.add(ends_at[at - 1], ends_at[at])
            else:
                counts.add(np.zeros(len(at), np.uint64), keys[at])
            if counts.size > HELD:
                yield from counts.whole()
    if counts.held:
        yield from counts.whole()


def _renamed(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """Words (gram, n) by their keys, and whether each is the end of a text."""
    for batch in batches:
        words = batch.column("gram").to_numpy().view(np.uint64)
        keys = _numbered(words, ranks.value) if len(words) else words
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("n"), pa.array(words == END)], names=["gram", "n", "ends"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the key of their gram."""
    for batch in batches:
        one, two = (batch.column(x).to_numpy().view(np.uint64) for x in ("context", "suffix"))
        yield batch.append_column("gram", pa.array(_joint(one, two).view(np.int64)))


def _level(docs: DataFrame, contexts: DataFrame, below: DataFrame, depth: int, ranks: Broadcast, tokens: int) -> tuple[DataFrame, DataFrame]:
    """(rows, states) of one depth. contexts (context, met); below (gram, lp, ends): the next words of the retained suffixes.

    rows (gram, context, suffix, n, met, below, ends, kept) of what was found twice or more after the contexts; states (context,
    weight) of the retained ones, weight being log10 of the share that goes to the suffix."""
    spark = docs.sparkSession
    size = contexts.count()
    filled = spark.sparkContext.broadcast(key_filter(contexts.select("context"), bits_for(size)))
    counts = _settled(materialize(_counts(docs, depth, 2, tokens, ranks, filled), "pairs"))
    rows = counts.join(below.select(F.col("gram").alias("suffix"), F.col("lp").alias("below"), "ends"), "suffix").join(F.broadcast(contexts) if size <= SMALL else contexts, "context")
    expected = F.col("met") * F.pow(F.lit(10.0), "below")
    more = F.col("n") - expected
    kept = (more > 0) & (F.col("n") * F.log(F.col("n") / expected) - more > NEXT)
    rows = rows.select("context", "suffix", "n", "met", "below", "ends", kept.alias("kept"))
    rows = materialize(in_arrow(rows, _keyed, "context long, suffix long, n long, met long, below double, ends boolean, kept boolean, gram long"), "grams")
    _settled(rows)
    release(counts)
    filled.unpersist()
    own = rows.where("kept")
    sums = own.groupBy("context").agg(F.first("met").alias("met"), F.sum("n").alias("n"), F.sum(F.col("n") - DISCOUNT).alias("found"))
    sums = materialize(sums.select("context", F.log((F.col("met") - F.col("found")) / F.col("met")).alias("share"), (F.col("met") - F.col("n")).alias("other"), F.col("found")), "sums")
    # Each token is predicted from the others: its own count is taken from those of its gram.
    left = F.greatest(F.col("n") - 1 - DISCOUNT, F.lit(0.0)) + (F.col("met") - F.col("found")) * F.pow(F.lit(10.0), "below")
    gain = F.sum(F.col("n") * F.log(left / F.col("met") / F.pow(F.lit(10.0), "below")))
    gains = _sent_if_small(own, sums).groupBy("context").agg((gain + F.first("other") * F.first("share")).alias("gain"), F.first("share").alias("share"))
    states = materialize(gains.where(F.col("gain") > GAIN).select("context", (F.col("share") / math.log(10)).alias("weight")), "states")
    release(sums)
    return rows, _settled(states)


def _sent_if_small(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows with the columns of their context's state."""
    return rows.join(F.broadcast(states) if states.count() <= SMALL else states, "context")


def _smoothed(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(gram, n, lp, value, ends, kept) of the next words of retained contexts: log10 of the smoothed probability, and how
    much more it is than the suffix's with the weight."""
    back = F.col("weight") + F.col("below")
    lp = F.when(F.col("kept"), F.log10((F.col("n") - DISCOUNT) / F.col("met") + F.pow(F.lit(10.0), back))).otherwise(back)
    return _sent_if_small(rows, states).withColumn("lp", lp).select("gram", "n", "lp", (F.col("lp") - back).alias("value"), "ends", "kept")


def train(docs: DataFrame, *, depth: int = DEPTH, least: int = LEAST, frequent: int | None = None) -> SuffixTree:
    """The tree of the whole texts of docs (text); null is an empty text, which is one end. frequent: keys of either kind that
    go to every task, in place of the usual numbers."""
    size = docs.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # a word and its space have about six
    counts = materialize(_counts(docs, 0, 1, size // 6 + 1).select(F.col("suffix").alias("gram"), "n"), "counts")
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(counts))
    words = materialize(in_arrow(counts, lambda b: _renamed(b, ranks), "gram long, n long, ends boolean"), "words")
    release(counts)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    lp = F.log10((F.col("n") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    below = words.select("gram", "n", lp.alias("lp"), "ends")
    whole = words.select("gram", "n", lp.alias("base"), F.lit(0.0).alias("value"))
    contexts = below.where("not ends").where(F.col("n") >= least).select(F.col("gram").alias("context"), F.col("n").alias("met"))
    written = [words]
    for k in range(1, depth + 1):
        contexts = materialize(contexts, "contexts")
        rows, states = _level(docs, contexts, below, k, ranks, n)
        written += [contexts, rows, states]
        weights = states.join(contexts, "context").select(F.col("context").alias("gram"), F.col("met").alias("n"), F.col("weight").alias("value"))
        for part in (_smoothed(rows.where("kept"), states).select("gram", "n", "value"), weights):
            whole = whole.unionByName(part.withColumn("base", F.lit(None).cast("double")))
        below = _smoothed(rows, states)
        often = rows.where("not ends").where(F.col("n") >= least)
        contexts = often.join(states.select(F.col("context").alias("suffix")), "suffix", "left_semi").select(F.col("gram").alias("context"), F.col("n").alias("met"))
    model = whole.groupBy("gram").agg(F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("value").alias("value"))
    model = _settled(materialize(model, "model"))
    release(*written)
    words, rare = _frequent(model.where("base is not null"), FREQUENT_WORDS if frequent is None else frequent)
    grams, rest = _frequent(model.where("base is null"), FREQUENT if frequent is None else frequent)
    others = rare.unionAll(rest).select("gram", "base", "value")
    many = others.count()
    send = docs.sparkSession.sparkContext.broadcast
    sent = [send(tuple(t[x].to_numpy().view(np.uint64 if x == "gram" else np.float64) for x in names)) for t, names in ((words, ("gram", "base", "value")), (grams, ("gram", "value")))]
    filled = send(key_filter(others.select("gram"), bits_for(many, 10)))
    return SuffixTree(_settled(others), -(-many // KEYS) or 1, n, v, ranks, *sent, filled)


def _ranks(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of counts (gram, n) in order of their hashes, and their numbers, 1 for the most frequent."""
    found, _ = _frequent(counts.where(F.col("gram") != int(END.view(np.int64))), RANKED)
    keys = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(-found["n"].to_numpy(), kind="stable")
    numbers = np.zeros(len(keys) + 1, np.uint64)
    numbers[order] = np.arange(1, len(keys) + 1, dtype=np.uint64)
    numbers[-1] = _END_RANK
    keys = np.append(keys, END)
    at = np.argsort(keys)
    return keys[at], numbers[at]


def _frequent(rows: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """The rows (gram, n, any others) of the greatest n, at most so many, in order of gram (unsigned), and the other rows. Rows are taken by steps of the logarithm of n, of which there are under a thousand."""
    step = F.floor(F.log2("n") * 16).cast("int")
    least, room = 1 << 20, most
    for row in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        if row["k"] > room:
            break
        least, room = row["step"], room - row["k"]
    found = rows.where(step >= least).toArrow()
    found = found.take(pa.array(np.argsort(found["gram"].to_numpy().view(np.uint64))))
    return found, rows.where(step < least)


_SENT = "bucket int, kind int, chunk long, rows binary"
#: Kinds of rows that are sent: to a bucket, keys of the model and keys asked (with the text and how often); to a chunk, its
#: texts (ids, whether there are ids, buckets asked, tokens, sums over frequent grams) and the answers.
_MODEL, _ASKED, _TEXTS, _ANSWER = range(4)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key. Grams of numbered words that differ in the last one only (65,536 at most) share a bucket, where
    they compress."""
    return (mix((keys >> np.uint64(16)) * _LEFT + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, chunk, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "chunk", "rows"])


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys of the model (gram, base, value) by bucket."""
    held: list[list[np.ndarray]] = []

    def whole() -> Iterator[pa.RecordBatch]:
        keys, *values = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = _bucket(keys, buckets)
        order = np.lexsort((keys, bucket))
        keys, values = keys[order], [x[order] for x in values]
        for j, own in _by_bucket(bucket[order], buckets):
            yield _sent([(j, _MODEL, 0, _packed(_steps(keys[own]), *(x[own] for x in values)))])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column("gram").to_numpy().view(np.uint64), *(batch.column(x).to_numpy(zero_copy_only=False).astype(np.float64) for x in ("base", "value"))])
        if sum(len(x[0]) for x in held) > HELD:
            yield from whole()
    if held:
        yield from whole()


class _Chunk:
    """Texts, their sums over frequent grams, and the other grams that the model may hold."""

    def __init__(self) -> None:
        self.texts: list[list[np.ndarray]] = []
        self.rows: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.print = np.uint64(0)
        self.size = self.asked = 0

    def add(self, prints: np.ndarray, *texts: np.ndarray) -> None:
        self.print = mix(np.append(self.print, prints + np.arange(len(prints), dtype=np.uint64) * _LEFT).sum(keepdims=True))[0]
        self.texts.append(list(texts))
        self.size += len(prints)

    def ask(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """Keys of grams of the texts that were added last, and which of those they are in (in order)."""
        self.rows.append(rows + self.size - len(self.texts[-1][0]))
        self.keys.append(keys)
        self.asked += len(keys)

    def whole(self, place: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """place: a number that no other chunk has. With a hash of the texts it makes the chunk's number, so that a task that is
        run again and finds other rows can't be taken for the first."""
        chunk = int(mix(np.array([self.print], np.uint64) + np.array([place], np.uint64) * _RIGHT).view(np.int64)[0])
        rows, keys = np.concatenate(self.rows), np.concatenate(self.keys)
        bucket = _bucket(keys, buckets)
        order = np.lexsort((rows, keys, bucket))
        rows, keys, bucket = rows[order], keys[order], bucket[order]
        fresh = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(np.append(True, fresh)[: len(keys)])  # a key in a text
        times, rows, keys = np.diff(np.append(at, len(keys))), rows[at], keys[at]
        asked = list(_by_bucket(bucket[at], buckets))
        ids, there, *texts = (np.concatenate(x) for x in zip(*self.texts, strict=True))
        yield _sent([(chunk % buckets, _TEXTS, chunk, _packed(ids, there, np.full(len(ids), len(asked)), *texts))])
        for k in range(0, len(asked), 64):
            yield _sent([(j, _ASKED, chunk, _packed(_steps(keys[own]), rows[own], times[own])) for j, own in asked[k : k + 64]])


def _looked_up(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, held: int, ranks: Broadcast, words: Broadcast, frequent: Broadcast, filled: Broadcast) -> Iterator[pa.RecordBatch]:
    """Chunks of texts with about so many grams held, and the keys that they ask for, by bucket."""
    task = TaskContext.get()
    chunk, place = _Chunk(), (task.partitionId() if task else 0) << 32
    for batch in batches:
        ends, data = buffers(batch.column("text"))
        ids = batch.column("doc_id")
        there, ids = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
        for a, b in slices(ends, SLICE):
            tokens, bounds = _tokens(data, ends[a : b + 1])
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            at = np.arange(len(tokens), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
            prints = mix(np.add.reduceat(mix(tokens + at * _LEFT), bounds[:-1]) + ids[a:b].view(np.uint64) * _RIGHT)
            sums = np.zeros((3, b - a))  # known, base, value
            asked = []
            for size, (gram, whole) in enumerate(_grams(_numbered(tokens, ranks.value), bounds, depth + 1), 1):
                at = np.flatnonzero(whole)
                distinct, back = np.unique(gram[at], return_inverse=True)
                keys, *columns = words.value if size == 1 else frequent.value
                k = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                hit = keys[k] == distinct if len(keys) else np.zeros(len(distinct), bool)
                if len(keys):
                    if len(columns) == 2:
                        sums[0] += np.bincount(row[at], hit[back], minlength=b - a)
                    for out, column in zip(sums[-len(columns) :], columns, strict=True):
                        out += np.bincount(row[at], np.where(hit, column[k], 0)[back], minlength=b - a)
                rest = at[(~hit & may_hold(filled.value, distinct))[back]]
                asked.append((row[rest], gram[rest]))
            chunk.add(prints, ids[a:b], there[a:b], np.diff(bounds), *sums)
            for own in asked:
                chunk.ask(*own)
            if max(chunk.asked, chunk.size) > held:
                yield from chunk.whole(place, buckets)
                chunk, place = _Chunk(), place + 1
    if chunk.size:
        yield from chunk.whole(place, buckets)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and kind: the keys asked are answered by base and value, what is for the chunk goes on to it."""
    held: list[list[np.ndarray]] = []
    now, table = None, None
    for batch in batches:
        for bucket, kind, chunk, rows in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "chunk")), batch.column("rows"), strict=True):
            if bucket != now:
                held, now, table = [], bucket, None
            if kind == _MODEL:
                steps, *values = _unpacked(rows.as_py(), np.uint64, np.float64, np.float64)
                held.append([np.cumsum(steps, dtype=np.uint64), *values])
            elif kind != _ASKED:
                yield _sent([(bucket, kind, chunk, rows.as_py())])
            else:
                if table is None:
                    keys, *values = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
                    order = np.argsort(keys)
                    # One place more than keys, with the values of a key that is not in the model.
                    held, table = [], (keys[order], np.append(values[0][order], np.nan), np.append(values[1][order], 0.0))
                keys, *values = table
                steps, texts, times = _unpacked(rows.as_py(), np.uint64, np.int64, np.int64)
                asked = np.cumsum(steps, dtype=np.uint64)
                at = np.searchsorted(keys, asked)
                at[np.append(keys, np.uint64(0))[at] != asked] = len(keys)
                bases, found = (x[at] for x in values)
                met = ~np.isnan(bases)
                own, back = np.unique(texts, return_inverse=True)
                sums = [np.bincount(back, times * x) for x in (met, np.where(met, bases, 0), found)]
                yield _sent([(bucket, _ANSWER, chunk, _packed(_steps(own.view(np.uint64)), *sums))])


def _scored(batches: Iterator[pa.RecordBatch], unknown: float) -> Iterator[pa.RecordBatch]:
    """The scores of each text, from rows in order of chunk, kind and bucket."""
    held: dict[int, list[bytes]] = {}
    now = None

    def whole() -> pa.RecordBatch:
        ids, there, asked, tokens, *sums = _unpacked(*held[_TEXTS], *[np.int64] * 4, *[np.float64] * 3)
        answers = held.get(_ANSWER, [])
        if len(answers) != asked[0]:
            raise RuntimeError("a chunk of texts lacks answers: its input was read again with other rows")
        for data in answers:
            steps, *terms = _unpacked(data, np.uint64, *[np.float64] * 3)
            rows = np.cumsum(steps, dtype=np.uint64).astype(np.int64)  # distinct
            for out, term in zip(sums, terms, strict=True):
                out[rows] += term
        known, base, value = sums
        held.clear()
        known = np.rint(known).astype(np.int64)
        base = base + (tokens - known) * unknown
        columns = [pa.array(ids, mask=there == 0), *map(pa.array, (tokens, known, base, base + value))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for chunk, kind, rows in zip(batch.column("chunk").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            if held and chunk != now:
                yield whole()
            now = chunk
            held.setdefault(kind, []).append(rows.as_py())
    if held:
        yield whole()


def score(docs: DataFrame, tree: SuffixTree, *, depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id, text; other columns are ignored).

    n_tokens counts the text's words and its end, n_known those met in training; base_score is the root's log10 probability
    of the text, score the tree's. A null or empty text is one end. Repeated rows have a row each; rows without an id are
    scored. With no training texts every probability of the root is 1 and both scores are 0. depth: that of the training;
    held: grams that a task looks up together. If a lost task finds its rows in another order, the job may fail and has to be
    run again; it never mixes the two.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks, words, grams, filled, buckets, unknown = tree.ranks, tree.words, tree.grams, tree.filled, tree.buckets, tree.unknown
    asked = in_arrow(own, lambda b: _looked_up(b, depth, buckets, held, ranks, words, grams, filled), _SENT)
    keys = in_arrow(tree.others, lambda b: _dealt(b, buckets), _SENT)
    answers = in_arrow(keys.unionAll(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"), _answered, _SENT)
    whole = answers.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return in_arrow(whole, lambda b: _scored(b, unknown), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves rest; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def lm_scores(docs: DataFrame, *, mod: int = 5, rest: int = 1, depth: int = DEPTH, least: int = LEAST, frequent: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): each row of docs scored by the tree of the
    rows whose crc32(doc_id as text) mod ``mod`` is not ``rest``. Rows without an id are training texts."""
    out = held_out(mod, rest)
    tree = train(docs.where(~out), depth=depth, least=least, frequent=frequent)
    scored = score(docs, tree, depth=depth)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
