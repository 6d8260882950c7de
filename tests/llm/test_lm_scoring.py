"""Language-model scores against a suffix tree of plain dictionaries."""

import dataclasses
import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from edge import docs
from pyspark.sql import functions as F

from gridloom.llm import lm_scoring
from gridloom.llm.filters import bits_for
from gridloom.llm.lm_scoring import DISCOUNT, GAIN, NEXT, lm_scores, score, train

END = None


def tokens(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [*(text or "").encode().translate(table).split(), END]


class Brute:
    """The tree by the definition: counts of all grams, contexts from short to long, probabilities by recursion."""

    def __init__(self, texts, depth, least):
        grams, self.depth = Counter(), depth
        for text in texts:
            own = tokens(text)
            for size in range(1, depth + 2):
                grams.update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
        self.words = Counter({g[0]: n for g, n in grams.items() if len(g) == 1})
        self.n, self.v, self.states = sum(self.words.values()), len(self.words), {}
        candidates = {()}
        for size in range(1, depth + 1):
            now = {g for g in grams if len(g) == size and g[-1] is not END and grams[g] >= least and g[:-1] in candidates and (size == 1 or g[1:] in self.states)}
            after = defaultdict(dict)
            for g, n in grams.items():
                if len(g) == size + 1 and n > 1 and g[:-1] in now:
                    after[g[:-1]][g[-1]] = n
            fresh = {}
            for h, children in after.items():
                met = grams[h]
                expected = {x: met * self.p(x, h[1:]) for x in children}
                children = {x: n for x, n in children.items() if n > (e := expected[x]) and n * math.log(n / e) - (n - e) > NEXT}
                if not children:
                    continue
                found = sum(n - DISCOUNT for n in children.values())
                gain = sum(n * math.log((max(n - 1 - DISCOUNT, 0) + (met - found) * self.p(x, h[1:])) / met / self.p(x, h[1:])) for x, n in children.items())
                gain += (met - sum(children.values())) * math.log((met - found) / met)
                if gain > GAIN:
                    fresh[h] = (met, (met - found) / met, children)
            self.states |= fresh
            candidates = now

    def p(self, x, history):
        if not history:
            return (self.words.get(x, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))
        if history not in self.states:
            return self.p(x, history[1:])
        met, share, children = self.states[history]
        return (children[x] - DISCOUNT if x in children else 0) / met + share * self.p(x, history[1:])

    def of(self, text):
        own = tokens(text)
        total = 0.0
        for i, x in enumerate(own):
            history = tuple(own[max(0, i - self.depth) : i])
            while history and history not in self.states:
                history = history[1:]
            total += math.log10(self.p(x, history))
        return len(own), sum(self.words.get(x, 0) > 0 for x in own), sum(math.log10(self.p(x, ())) for x in own), total


def prose(seed, n):
    random = np.random.default_rng(seed)
    follow = random.integers(0, 60, (60, 60, 3))
    rows = []
    for i in range(n):
        a, b, out = 0, 1, []
        for _ in range(int(random.integers(0, 80))):
            a, b = b, int(follow[a, b, random.integers(0, 3)]) if random.random() < 0.8 else int(random.integers(0, 60))
            out.append(f"Word{b}" if random.random() < 0.5 else f"word{b}")
        rows.append((i, " ".join(out), None, None))
    phrases = ["alpha x p q", "beta x p r", "p z", "y p z"]  # each word before p says more of what follows it
    rows += [(2000 + k, " ".join(phrases[j] for j in random.integers(0, 4, 12)), None, None) for k in range(30)]
    return rows + [(n, "Word1 word2 word3 " * 400, None, None), (n + 1, "word1 never seen before", None, None)]


@pytest.mark.parametrize("depth,least,frequent", [(2, 16, None), (2, 4, 0), (3, 6, 20), (1, 2, 5)])
def test_equals_plain_dictionaries(spark, depth, least, frequent):
    rows = prose(depth, 250)
    rows += [(3, rows[3][1], None, None), (None, "word5 word6 word7", None, None), (900, None, None, None), (901, "", None, None)]
    got = sorted(map(tuple, lm_scores(docs(spark, rows).repartition(3), depth=depth, least=least, frequent=frequent).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tree = Brute([r[1] for r in rows if not held(r[0])], depth, least)
    assert any(len(h) == depth for h in tree.states)
    want = []
    for r in rows:
        n, known, base, total = tree.of(r[1])
        want.append((r[0], held(r[0]), n, known, tree.n, base, total))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_probabilities_of_each_state_sum_to_one():
    tree = Brute([r[1] for r in prose(5, 200)], 2, 8)
    assert len(tree.states) > 20
    for h in [(), *tree.states]:
        assert math.isclose(sum(tree.p(x, h) for x in tree.words) + tree.p(b"never met", h), 1)


def test_edge_rows(spark):
    got = {r["doc_id"]: r for r in lm_scores(docs(spark)).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1
    assert lm_scores(docs(spark)).where("doc_id = 3").count() == 2
    assert lm_scores(docs(spark, []).limit(0)).count() == 0
    one = lm_scores(docs(spark, [(5, "a b", None, None)])).first()  # crc32 of 5 leaves no training text or this one
    assert one["n_tokens"] == 3 and one["score"] == one["base_score"]


def test_held_out_texts_of_the_table_gain_over_the_base(spark, small):
    from gridloom.llm.queries import op13_lm_scoring

    out = op13_lm_scoring(spark, small)
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    sums = out.groupBy("held_out").agg(F.sum("base_score"), F.sum("score")).collect()
    assert all(r[2] >= r[1] for r in sums)


def test_no_training_text(spark):
    tree = train(docs(spark).limit(0))
    out = score(docs(spark), tree).collect()
    assert len(out) == 10 and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in out)


def test_scores_do_not_depend_on_chunks_and_buckets(spark):
    rows = prose(7, 120) + [(3, "word1 word2 word3", None, None), (3, "word1 word2 word3", None, None), (None, "word5 word6", None, None), (900, None, None, None)]
    tree = train(docs(spark, rows), least=4, frequent=3)
    plain = lambda df: np.array(sorted(map(tuple, df.fillna(-1).collect())))
    want = plain(score(docs(spark, rows), tree))
    got = plain(score(docs(spark, rows).repartition(5, "doc_id"), dataclasses.replace(tree, buckets=7), held=100))
    assert len(want) == len(rows) and np.allclose(got, want, rtol=1e-9, atol=1e-9)
    alone = score(docs(spark, rows[:1]).limit(1), tree)  # a chunk of one text
    assert np.allclose(plain(alone), want[want[:, 0] == rows[0][0]], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_counted_pairs_come_back_from_few_bytes(depth):
    random = np.random.default_rng(depth)
    words = np.minimum(random.zipf(1.3, 400_000), 60_000).astype(np.uint64)
    grams = [keys for keys, _ in lm_scoring._grams(words, np.array([0, len(words)]), max(depth, 1))]
    context, suffix = (grams[-1][:-1], grams[-1][1:]) if depth else (np.zeros(len(words) - 1, np.uint64), words[1:])
    odd = random.random(len(suffix)) < 0.01
    suffix = np.where(odd, suffix * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1 << 63), suffix)
    pairs = lm_scoring._Counts(5, depth)
    for k in range(0, len(suffix), 90_000):
        pairs.add(context[k : k + 90_000], suffix[k : k + 90_000])
    sent = list(pairs.whole())
    got = [lm_scoring._pairs_unpacked(x, depth) for batch in sent for x in batch.column("rows").to_pylist()]
    found = Counter()
    for c, s, n in got:
        found.update(dict(zip(zip(c.tolist(), s.tolist(), strict=True), n.tolist(), strict=True)))
    assert found == Counter(zip(context.tolist(), suffix.tolist(), strict=True))
    data = b"".join(x for batch in sent for x in batch.column("rows").to_pylist())
    assert len(pa.compress(data, codec="lz4", asbytes=True)) < 7.5 * len(found)  # 24 bytes as they are


def test_keys_asked_take_few_bytes():
    """What a chunk sends goes with a few bytes for each key in a text, in one array for each bucket."""
    n = 3000
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": [" ".join(f"w{(7 * i + k) % 500}" for k in range(40)) for i in range(n)]})
    send = lambda x: SimpleNamespace(value=x)
    none = (np.zeros(1, np.uint64), np.zeros(1, np.uint64))
    full = np.full(bits_for(1) // 8, 255, np.uint8)  # a filter that may hold every key
    empty = np.zeros(0)
    out = [x for b in lm_scoring._looked_up(iter([batch]), 2, 4, 10**6, send(none), send((empty, empty, empty)), send((empty, empty)), send(full)) for x in b.to_pylist()]
    asked = [x for x in out if x["kind"] == lm_scoring._ASKED]
    grams = n * (41 + 40 + 39)
    assert sum(int(lm_scoring._unpacked(x["rows"], np.uint64, np.int64, np.int64)[2].sum()) for x in asked) == grams
    assert sorted(x["bucket"] for x in asked) == [0, 1, 2, 3] and len(out) == 5
    assert sum(len(x["rows"]) for x in out) < 4 * grams  # 16 and more as rows of a table
