import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from edge import ROWS, docs
from pyspark.sql import functions as F

from gridloom.llm.line_dedup import Confirmed, line_dedup


def key(line):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line).strip(" \t\n\x0b\x0c\r")


def brute(texts, least):
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} - {""})
    for t in texts:
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if count[key(x)] < least)
        yield len(lines), sum(count[key(x)] >= least for x in lines), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_edge_rows_equal_brute_force(spark, sent):
    for least in (2, 10):
        got = sorted(tuple(r) for r in line_dedup(docs(spark), min_docs=least, sent=sent).select("n_lines", "n_dropped", "kept_sha256").collect())
        assert got == sorted(brute([r[1] for r in ROWS], least))


def test_columns_and_no_rows(spark):
    df = docs(spark, [])
    out = line_dedup(df)
    assert out.count() == 0 and set(df.columns) <= set(out.columns)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_clashing_inner_names(spark, sent):
    df = docs(spark).withColumns({x: F.lit("own") for x in ("gone__", "affected__", "gone_id__", "first_doc", "k1", "k2", "piece", "bits", "id")})
    out = line_dedup(df, min_docs=2, sent=sent)
    assert set(df.columns) <= set(out.columns)
    assert all(r["gone__"] == r["affected__"] == r["gone_id__"] == r["k1"] == "own" for r in out.collect())


def test_keys_that_share_a_word():
    one = np.array([5, 5, 7, 5], np.int64)
    two = np.array([1, 2, 1, 3], np.int64)
    first, known = np.array([1, 2, 0, 4]), np.array([True, True, False, True])
    pairs = np.array([[5, 1], [5, 2], [5, 3], [5, 4], [7, 1], [7, 2], [9, 1]], np.int64)
    table = Confirmed(one, two, first, known, False)
    assert table.gone(pairs, np.zeros(7, int), np.ones(7, bool)).tolist() == [True, True, True, False, True, False, False]
    table = Confirmed(one, two, first, known, True)
    assert table.gone(pairs, np.array([1, 1, 0, 1, 1, 1, 1]), np.arange(7) != 2).tolist() == [False, True, False, False, False, False, False]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_ids_beyond_the_whole_numbers_of_a_double(spark, sent):
    ids = [1 << 60, (1 << 60) + 1, (1 << 60) + 64, -(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(i, f"same line\nown {k}") for k, i in enumerate(ids[:3])] + [(i, f"other\nown {i}") for i in ids[3:]], "doc_id long, text string")
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup(df, min_docs=2, keep_first=True, sent=sent).collect()}
    assert out == {ids[0]: 0, ids[1]: 1, ids[2]: 1, ids[3]: 0, ids[4]: 1}
    both = docs(spark).unionByName(docs(spark).withColumn("doc_id", F.col("doc_id") + (1 << 60)))
    rows = [sorted(map(str, line_dedup(both, min_docs=2, keep_first=True, sent=n).select("doc_id", "n_dropped", "kept_sha256").collect())) for n in (1 << 20, 0)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_first_occurrence_can_stay(spark, sent):
    df = spark.createDataFrame([(k, f"same line\nown {k}") for k in range(12)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup(df, keep_first=True, sent=sent).collect()}
    assert out[0] == "same line\nown 0" and all(out[k] == f"own {k}" for k in range(1, 12))


def test_ties_at_the_threshold(spark):
    rows = [(k, "nine" if k < 9 else "ten\n TEN ") for k in range(19)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in out} == {k: 0 if k < 9 else 2 for k in range(19)}
