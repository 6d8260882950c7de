import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from edge import ROWS, docs
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, token_counts, token_store, units
from gridloom.llm.common import buffers, new_path

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
WHOLE = Tokenizer.from_file(JSON)
ODD = st.text(alphabet=st.sampled_from(list(" \t\n\r\x0b\x1c  　abcABC'stré9٣!?-_\U0001f600中")), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    return WHOLE


@pytest.fixture(scope="module")
def rank_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


SPECIAL = st.lists(st.one_of(ODD, st.just("<|endoftext|>"), st.just(" <|endoftext|>")), max_size=4).map("".join)


@given(st.lists(SPECIAL, min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_cut_texts_encode_as_whole_ones(texts):
    flat, counts = zip(*token_store.encoded(pa.array(texts), JSON), strict=True)
    stops = np.cumsum(np.concatenate(counts)).tolist()
    ids = np.concatenate(flat).tolist()
    for text, a, b in zip(texts, [0, *stops[:-1]], stops, strict=True):
        assert ids[a:b] == WHOLE.encode(text, add_special_tokens=False).ids


@given(st.lists(ODD, min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_pattern_in_units_is_the_pattern_in_the_text(texts):
    import regex

    pattern = regex.compile(P.PATTERN)
    ends, data = buffers(pa.array(texts))
    starts, rows = units.unit_starts(data, ends)
    raw, cuts = data[int(ends[0]) : int(ends[-1])].tobytes(), [*starts.tolist(), int(ends[-1] - ends[0])]
    for k, text in enumerate(texts):
        own = [raw[cuts[j] : cuts[j + 1]].decode() for j in range(rows[k], rows[k + 1])]
        assert "".join(own) == text
        assert [p for u in own for p in pattern.findall(u)] == pattern.findall(text)


def test_units_come_over_from_the_older_generation():
    calls = []

    def of(keys):
        calls.extend(keys)
        return np.concatenate([np.frombuffer(k, np.uint8) for k in keys]).astype(np.uint32), np.array([len(k) for k in keys])

    table = units.Units(of, np.zeros(0, np.uint32), most=3)
    for text in ("a b c d e", "a f g h i", "a j k l m", "a n o p q"):
        ends, data = buffers(pa.array([text]))
        flat, counts, _, _ = table.values(data, ends)
        assert bytes(flat.astype(np.uint8)) == text.encode() and counts.tolist() == [len(text)]
    assert calls.count(b"a") == 1


def test_store_round_trip(spark, tokenizer):
    rows = [*ROWS, (9, "a <|endoftext|>b", "en", "b"), (10, "<|endoftext|>", "en", "b")]
    token_store.write_store(docs(spark, rows), path := new_path(spark, "test"), JSON)
    want = [np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4") for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]
    assert want[-2].tolist() == [64, 220, 50256, 65, 2]
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r["n_tokens"] for r in got] == [len(x) for x in want]
    assert [r["start"] for r in got] == (np.cumsum([len(x) for x in want]) - [len(x) for x in want]).tolist()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x.tobytes()) for x in want]
    ids = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["ids"] for r in ids] == [x.tolist() for x in want]
    chunks = spark.read.parquet(f"{path}/pack/kind=chunk")
    assert chunks.count() == chunks.select("k1", "k2").distinct().count()


def test_empty_store(spark):
    token_store.write_store(docs(spark, []), path := new_path(spark, "test"), JSON)
    assert token_store.read_digests(spark, path).count() == 0 and token_store.read_documents(spark, path).count() == 0


def test_changed_ids_are_noticed(spark):
    token_store.write_store(docs(spark), path := new_path(spark, "test"), JSON)
    bad = new_path(spark, "test")
    chunks = spark.read.parquet(f"{path}/pack/kind=chunk")
    chunks.withColumn("payload", F.expr("unhex(concat('0000', substr(hex(payload), 5)))")).write.parquet(f"{bad}/pack/kind=chunk")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    with pytest.raises(Exception, match="does not hold the ids"):
        token_store.read_digests(spark, bad).collect()


@given(st.lists(st.lists(st.integers(0, 50255), min_size=1, max_size=5_000).map(lambda x: x * 3), min_size=1, max_size=4))
@settings(max_examples=20, deadline=None)
def test_chunks_cover_the_streams_within_bounds(streams):
    stops = np.cumsum([len(x) for x in streams])
    ends = token_store.chunk_ends(np.concatenate(streams).astype("<u4"), stops)
    assert ends == sorted(set(ends)) and set(stops.tolist()) <= set(ends)
    alone, before = [], 0
    for ids in streams:
        sizes = np.diff([0, *(own := token_store.chunk_ends(np.array(ids, "<u4"), np.array([len(ids)])))])
        assert (sizes[:-1] >= token_store.LEAST).all() and (sizes <= token_store.MOST).all()
        alone += [before + x for x in own]
        before += len(ids)
    assert ends == alone


@given(st.binary(max_size=50), st.binary(max_size=50))
@settings(deadline=None)
def test_crc32_of_both(a, b):
    assert token_store.crc32_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_bpe_equals_the_rank_library(spark, rank_encoding):
    texts = [r[1] for r in ROWS] + ["aaaaaaaaaaaaaaaa", "--- -- ---- -", "\x1c\x1c a", "   lead", "trail   ", "a  b", "\U0001f600\U0001f600", "<|endoftext|>", "中文 текст"]
    df = docs(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    out = sorted(byte_bpe.encode_decode(df, RANKS, P.PATTERN).collect(), key=lambda r: r["doc_id"])
    for r, text in zip(out, texts, strict=True):
        ids = np.array(rank_encoding.encode_ordinary(text or ""), "<u4")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids.tolist()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert bytes(r["decoded"]) == (text or "").encode() and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert r["n_words"] == "own"
    assert byte_bpe.encode_decode(docs(spark, []), RANKS, P.PATTERN, streams=()).count() == 0


def test_words_are_sent_again_after_forgetting():
    import regex

    texts = [f"word{k} again, word{k // 2}" for k in range(300)]
    pattern, own, seen, forgot = regex.compile(P.PATTERN), ["again"], 0, 0
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 10)), pa.array(texts[k : k + 10])], names=["k", "text"]) for k in range(0, 300, 10)]
    for batch in byte_bpe._split(iter(batches), P.PATTERN, ["k"], 50, [b"again"]):
        for k, words, numbers in zip(*(batch.column(x).to_pylist() for x in ("k", "words__", "numbers__")), strict=True):
            if words is not None:
                forgot += not words
                own = own + [bytes(w).decode() for w in words] if words else ["again"]
            else:
                assert [own[x] for x in np.frombuffer(numbers, np.int32)] == pattern.findall(texts[k])
                seen += 1
    assert seen == 300 and forgot > 3


def test_results_after_forgetting(spark, monkeypatch, rank_encoding):
    texts = [" ".join(f"w{k * 40 + j}x" for j in range(40)) + f" again, {k}" for k in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)) * 9, "k int, text string").coalesce(1)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 200)
    monkeypatch.setattr(byte_bpe, "SAMPLE", 20)
    out = byte_bpe.encode_decode(df, RANKS, P.PATTERN).collect()
    for r in out:
        ids = np.array(rank_encoding.encode_ordinary(texts[r["k"]] or ""), "<u4")
        assert bytes(r["ids"]) == ids.tobytes() and bytes(r["decoded"]) == (texts[r["k"]] or "").encode()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_equal_whole_offsets(spark, tokenizer, rule):
    out = token_counts.section_tokens(docs(spark).repartition(2).where("doc_id is not null and doc_id <> 3"), JSON, rule=rule).collect()
    for doc, text, _, _ in ROWS:
        if doc in (None, 3):
            continue
        rows = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["section"])
        text = text or ""
        offsets = np.array(tokenizer.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        edges = np.array([*(r["first_char"] for r in rows), len(text)])
        want, crossing = np.zeros(len(rows), int), np.zeros(len(rows), int)
        for a, b in offsets:
            inside = [max(0, min(b, e) - max(a, s)) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            met = [k for k, n in enumerate(inside) if n]
            to = met[0] if rule == "start" else met[-1] if rule == "end" else int(np.argmax(inside))
            want[to] += 1
            crossing[to] += len(met) > 1
        assert [r["n_tokens"] for r in rows] == want.tolist() and [r["n_crossing"] for r in rows] == crossing.tolist()
        assert len(rows) == text.count("\n") + 1
    assert token_counts.section_tokens(docs(spark, []), JSON).count() == 0
    found = sorted(tuple(r)[1:] for r in out if r["doc_id"] == 8)
    again = token_counts.section_tokens(docs(spark, [(None, ROWS[9][1], None, None), (3, ROWS[9][1], None, None), (3, ROWS[9][1], None, None)]), JSON, rule=rule).collect()
    assert sorted(tuple(r)[1:] for r in again if r["doc_id"] is None) == found and sorted(tuple(r)[1:] for r in again if r["doc_id"] == 3) == sorted(found * 2)


def test_many_long_texts_in_one_batch(spark, tokenizer):
    texts = [f"line {k}\n" + "some more words here " * 6000 for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    n = {r["doc_id"]: r["n"] for r in token_counts.section_tokens(df, JSON).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert n == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
