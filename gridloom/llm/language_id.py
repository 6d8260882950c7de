"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter answers, for an n-gram, with the languages that contain it: a slot holds one bit per
language, and the AND of an n-gram's slots is a mask of languages. A text's n-grams give one popcount per language;
each is corrected for that language's false positive rate, (hits - N f) / (1 - f), and the largest decides. Each 64 languages
have a filter of their own, so that every labelled language has its bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, in_arrow, materialize, mix, release, slices

#: Lengths in bytes of the n-grams of lower-cased text in which runs of anything but letters are one space.
GRAMS = (3, 5)
#: Slots of a filter: at 64 languages 8 MB, so 8 MB are broadcast for each 64 languages begun.
SLOTS = 1 << 20
#: Languages of a filter; one bit each.
BITS = 64
UNKNOWN = "und"
_SPACE = np.full(256, 0x20, np.uint8)
_SPACE[97:123] = np.arange(97, 123)
_SPACE[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """Languages by bit, the slots of the filter of each BITS languages and each language's false positive rate."""

    languages: list[str]
    slots: list[np.ndarray]
    wrong: np.ndarray


def _grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, one text after another, and of each text the end of its hashes.

    A text has its own leading and trailing space, and no n-gram reaches over its end.
    """
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") for t in texts]
    data = _SPACE[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    keep[ends[:-1]] = True
    data, stops = data[keep].astype(np.uint64), np.cumsum(keep)[ends - 1]
    rolled = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for k in range(size):
        rolled |= data[k : k + len(rolled)] << np.uint64(8 * k)
    whole = np.ones(len(data), bool)
    for k in range(1, size):
        whole[np.maximum(stops - k, 0)] = False
    return mix(rolled[whole[: len(rolled)]] + np.uint64(size)), np.cumsum(np.maximum(np.diff(stops, prepend=0) - size + 1, 0))


#: Bytes of text that are looked at once; an n-gram takes some 60 bytes of a worker's memory.
PART = 256 << 10
#: N-grams of sampled documents that a task holds before it sends their counts.
HELD = 4 << 20


def _pieces(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column in groups of bounded size; null is empty."""
    ends, _ = buffers(column)
    for a, b in slices(ends, PART):
        yield [t or "" for t in column.slice(a, b - a).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the task's documents of a language each n-gram is; the n-gram null counts the documents."""
    found: dict[str, list[np.ndarray]] = {}
    docs: dict[str, int] = {}
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, sets in found.items():
            gram, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(gram) + 1)), pa.array([*gram.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), docs[lang]], pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        langs = iter(batch.column("lang").to_pylist())
        for texts in _pieces(batch.column("text")):
            for text in texts:
                lang = next(langs)
                docs[lang] = docs.get(lang, 0) + 1
                found.setdefault(lang, []).append(np.unique(np.concatenate([_grams([text], size)[0] for size in GRAMS])))
                held += len(found[lang][-1])
                if held > HELD:
                    yield from counted()
                    found, docs, held = {}, {}, 0
    yield from counted()


def train(docs: DataFrame, *, train_docs: int = 3000, least_share: float = 0.004) -> LanguageModel:
    """Fit on docs (doc_id, text, lang): about train_docs documents of each language, by a hash of doc_id.

    train_docs bounds the sample; an n-gram is entered for a language if at least least_share of its sampled documents
    and three of them have it (one, with under ten). Rows with a null text or lang are not used.
    """
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = docs.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(train_docs)) / F.count("*")).alias("share"))
    sample = docs.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")
    counts = in_arrow(sample, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.where("gram is null").select(F.col("lang").alias("l"), F.col("n").alias("docs"))
    kept = counts.where("gram is not null").join(F.broadcast(total), F.col("lang") == F.col("l")).where((F.col("n") >= F.least(F.lit(3), F.ceil(F.col("docs") / 5))) & (F.col("n") >= least_share * F.col("docs")))
    kept = materialize(kept.select("lang", "gram"), "grams")
    languages = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    slots, wrong = [], []
    for k in range(0, len(languages), BITS):
        part = languages[k : k + BITS]
        rows = kept.where(F.col("lang").isin(part)).toPandas()
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(part))
        slots.append(np.zeros(SLOTS, kind))
        for bit, (_, grams) in enumerate(rows.groupby("lang")["gram"]):  # in order of lang
            for at in _slots(grams.to_numpy().view(np.uint64)):
                slots[-1][at] |= kind(1 << bit)
            wrong.append(float((slots[-1] >> kind(bit) & kind(1)).mean()) ** 2)
    release(kept)
    return LanguageModel(languages, slots, np.array(wrong))


def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64), (grams >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)


def _classify(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the best language's bit and its corrected share of the n-grams."""
    hits, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for size in GRAMS:
        grams, stops = _grams(texts, size)
        x, y = _slots(grams)
        edges = np.concatenate([[0], stops])
        total += np.diff(edges)
        for k, slots in enumerate(model.slots):
            masks = slots[x] & slots[y]
            for bit in range(min(BITS, len(model.languages) - k * BITS)):
                run = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(bit)) & masks.dtype.type(1), dtype=np.int64)])
                hits[:, k * BITS + bit] += run[edges[1:]] - run[edges[:-1]]
    share = (hits / np.maximum(total, 1)[:, None] - model.wrong) / (1 - model.wrong)
    best = share.argmax(1)
    return best, np.clip(share[np.arange(len(texts)), best], 0, 1)


def _predict(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model: LanguageModel = held.value
    for batch in batches:
        names, scores = [], []
        for texts in _pieces(batch.column("text")):
            best, score = _classify(texts, model) if model.languages else (None, None)
            for k, text in enumerate(texts):
                known = bool(model.languages) and any(map(str.isalpha, text))
                names.append(model.languages[best[k]] if known else UNKNOWN)
                scores.append(float(score[k]) if known else 0.0)
        yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score (0 to 1): the corrected share of the text's n-grams that its language has.

    Every column but text passes unread; columns by the names of the results are replaced. A null text, or one without
    a letter, is UNKNOWN with score 0, as is every text where no language was learned. Ties go to the first language
    by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_arrow(docs, lambda b: _predict(b, held), f"{schema}, lang_pred string, score double")


def held_out(mod: int, rest: int):
    """Whether crc32 of doc_id as text leaves rest; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def known_language(docs: DataFrame, *, train_docs: int = 3000, least_score: float = 0.3) -> DataFrame:
    """docs without those whose language is unknown or is held by under least_score of their n-grams; columns stay."""
    names = docs.columns
    model = train(docs.where(~held_out(4, 2)), train_docs=train_docs)
    if not model.languages:
        return docs
    scored = predict(docs.withColumnsRenamed({x: f"{x}__own" for x in names if x in ("lang_pred", "score")}), model)
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"{x}__own": x for x in names}).select(*[f"`{x}`" for x in names])
