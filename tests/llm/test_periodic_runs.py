"""Runs of periodic words against the definition."""

import hashlib
import zlib

import numpy as np
import pytest
from edge import docs

from gridloom.llm.periodic_runs import periodic_runs, planted, runs


def brute(words, least=24, times=3):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, p, e - s) for (s, e), p in out.items())


def row(doc_id, text, rewrite=True, least=24, times=3):
    words = (text or "").encode().split()
    n = len(words)
    if rewrite and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, least, times)
    drop = {i for s, p, length in found for i in range(s + p, s + length)}
    best = min(((-length / p, s, p, length) for s, p, length in found), default=None)
    said = "".join(f"{s},{length},{p}\n" for s, p, length in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    head = (None,) * 4 if best is None else (best[1], best[3], best[2], 1000 * best[3] // best[2])
    return (doc_id, len(found), *head, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic(random, parts):
    out = []
    for _ in range(parts):
        block = [f"w{x}" for x in random.integers(0, random.integers(1, 4), random.integers(1, 9))]
        out += (block * 60)[: random.integers(1, 70)]
        if random.random() < 0.3:
            out += (out[-40:] * 4)[: random.integers(1, 160)]
    return " ".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_definition(spark, seed):
    random = np.random.default_rng(seed)
    rows = [(i, periodic(random, int(random.integers(1, 12))), None, None) for i in range(120)]
    out = periodic_runs(docs(spark, rows).repartition(3), rewrite=planted)
    assert sorted(map(tuple, out.collect())) == sorted(row(r[0], r[1]) for r in rows)


@pytest.mark.parametrize("least,times", [(1, 3), (5, 4), (2, 3)])
def test_all_short_words_of_two_letters(least, times):
    random = np.random.default_rng(least)
    texts = sorted((random.integers(0, 2, random.integers(0, 40)) for _ in range(400)), key=len, reverse=True)
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    want = sorted((int(b) + s, int(b) + s + length, p) for t, b in zip(texts, bounds, strict=False) for s, p, length in brute(t.tolist(), least, times))
    assert sorted(runs(np.concatenate(texts), bounds, least, times)) == want


def test_edge_rows(spark):
    from edge import ROWS

    rows = [*ROWS, (20, "x " * 5000, None, None), (21, "a b\n" * 9000 + "c", None, None), (None, "y " * 30, None, None), (30, "É é " * 12, "x", "y"), (40, "a\x0b" * 24, None, None)]
    out = periodic_runs(docs(spark, rows), rewrite=planted)
    assert sorted(map(tuple, out.collect()), key=str) == sorted((row(r[0], r[1]) for r in rows), key=str)
    assert periodic_runs(docs(spark, []).limit(0)).count() == 0


def test_a_text_of_one_word_takes_linear_work(spark):
    import time

    began = time.process_time()
    found = runs(np.zeros(1_000_000, np.int32), np.array([0, 1_000_000]))
    assert found == [(0, 1_000_000, 1)]
    assert time.process_time() - began < 60


def test_query_equals_the_definition_on_its_table(spark, small):
    from gridloom.llm.queries import op12_periodic_runs

    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if r["text"] is None or len(r["text"]) < 4000}
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, small).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == row(i, text) for i, text in short.items())
    assert sum(r[1] for r in got.values()) > 5
