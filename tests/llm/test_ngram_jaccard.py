import random
import re

import numpy as np
import pyarrow as pa
import pytest
from edge import docs

from gridloom.llm import ngram_jaccard as J


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, per_cent=75):
    found = [(i, sets(t)) for i, t in rows]
    up = list(range(len(found)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, (_, x) in enumerate(found):
        for j, (_, y) in enumerate(found[:k]):
            both = len(x & y)
            if x and y and 100 * both >= per_cent * (len(x) + len(y) - both):
                up[max(root(k), root(j))] = min(root(k), root(j))
    members: dict[int, list] = {}
    for k, (i, _) in enumerate(found):
        members.setdefault(root(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(found)), key=str)


def test_edge_rows_equal_brute_force(spark):
    df = docs(spark)
    got = sorted(map(tuple, J.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got == want


def test_no_rows(spark):
    df = docs(spark, [])
    assert J.jaccard_components(df).count() == 0
    assert J.near_duplicates_dropped(df).columns == df.columns


def family(rng, base, n, edits):
    for _ in range(n):
        words = base[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_chains_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = list(family(rng, [word() for _ in range(120)], 90, 3))  # near copies, some linked over others only
    texts += [" ".join(shared + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(60)]  # a common passage
    chain = [word() for _ in range(100)]
    for _ in range(25):
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [texts[0]] * 5
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_a_large_group_over_many_partitions_costs_pairs_in_proportion(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(80)]
    texts = list(family(rng, base, 1000, 1)) + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    sizes = []
    verified = J.verified
    monkeypatch.setattr(J, "verified", lambda docs, pairs, *x: sizes.append(pairs.count()) or verified(docs, pairs, *x))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = sorted(map(tuple, J.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) < 6 * 1000
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("seed", [3, 4])
def test_leftovers_in_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "BLOCK", 5)
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join(shared + [word() for _ in range(rng.randrange(5, 30))]) for _ in range(50)]
    texts += list(family(rng, [word() for _ in range(60)], 60, 4))
    rows = list(enumerate(texts))
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_a_tree_of_many_levels():
    rng = np.random.default_rng(7)
    n = rng.integers(5, 60, 5000)
    points = np.array([np.bincount(rng.integers(0, J.GROUPS, k), minlength=J.GROUPS) for k in n]).astype(np.uint16)
    tree = J.CountTree(n, points)
    assert len(tree.levels) == 3
    for k in range(0, 5000, 250):
        want = np.flatnonzero(J.may_reach(n[k], points[k], n, points, 75))
        assert sorted(tree.query(n[k], points[k], 75).tolist()) == want.tolist() and k in want


@pytest.mark.parametrize("block", [1024, 7])
def test_exact_mode_returns_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = list(family(rng, [word() for _ in range(120)], 30, 1))
    texts += [" ".join(shared + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(20)]
    texts += [texts[0]] * 3 + ["", None, "one two", "one two"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    classes = {}
    for k, t in enumerate(texts):
        classes.setdefault(frozenset(sets(t)) or k, k)
    want = set()
    for x, k in classes.items():
        for y, j in classes.items():
            if k < j and not isinstance(x, int) and not isinstance(y, int) and 100 * len(x & y) >= 75 * len(x | y):
                want.add((k, j))
    assert len(want) > 2 * len(classes)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    known, links = J.jaccard_links(df, exact=True)
    assert sorted((r["a"], r["b"]) for r in links.collect()) == sorted(want)
    got = {r["doc_id"]: r for r in J.jaccard_components(df, exact=True).collect()}
    for k, t in enumerate(texts):
        own = classes[frozenset(sets(t)) or k]
        assert got[k]["n_links"] == sum(own in pair for pair in want)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.values()), key=str) == brute([(r[0], r[1]) for r in rows])


def test_tree_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    tokens = [np.unique(np.concatenate([rng.choice(base, 300, replace=False), rng.integers(0, 1 << 62, int(k), dtype=np.uint64)])) for k in rng.integers(0, 80, 60)]
    n = np.array([len(t) for t in tokens])
    for groups in (J.GROUPS, J.FINE):
        points = J._counts(n, np.array([J._vector(t, groups) for t in tokens]))
        tree = J.CountTree(n, points)
        for k, x in enumerate(tokens):
            near = set(tree.query(n[k], points[k], 75).tolist())
            for j, y in enumerate(tokens):
                both = len(np.intersect1d(x, y))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    assert j in near


def test_shingle_hashes_tell_sets_apart():
    texts = ["a b c d e f", "A b C d e f", "a b c d", "a b c", "ab c", "a bc", "", None, "b a c d e f"]
    got = [tuple(x) for x in J.row_shingles(pa.array(texts))]
    assert got[0] == got[1] and len({got[k] for k in (0, 2, 3, 4, 5, 8)}) == 6 and got[6] == got[7] == ()
