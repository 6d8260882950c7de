import re
from collections import Counter

import numpy as np
from edge import ROWS, docs

from gridloom.llm import quality_classifier as C, quality_rules as R
from gridloom.llm.queries import op7_quality_rules, op8_quality_classifier


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts_of_edge_rows(spark):
    out = R.quality_rules(docs(spark)).collect()
    assert sorted(tuple(r[n] for n in NAMES) for r in out) == sorted(counts(r[1]) for r in ROWS)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert R.quality_rules(docs(spark, [])).count() == 0


def test_windows_that_share_the_upper_bits_of_their_hash(spark):
    """Their repeats alternate, so that neither stands beside its equal if only a part of the hash is sorted."""
    text = "w1576477 x y q1 w2804442 x y q2 w1576477 x y q3"
    long = " ".join(f"{'w1576477 x y' if k % 2 else 'w2804442 x y'} r{k}" for k in range(40))
    rows = [(1, text, "en", "s"), (2, long, "en", "s")]
    out = {r["doc_id"]: r["n_repeat_words"] for r in R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out == {1: counts(text)[4], 2: counts(long)[4]} and out[1] == 6


def test_repeats_do_not_hang_on_the_hash(spark, monkeypatch):
    """With a hash of four bits unequal windows collide all the time; their counts are still those of equal hashes."""
    from pyspark.sql import functions as F

    narrow = F.xxhash64
    monkeypatch.setattr(R.F, "xxhash64", lambda *c: F.pmod(narrow(*c), F.lit(16)).cast("long"))
    words = [f"w{k % 7}" for k in range(40)]
    own = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    slots = [r[0] for r in spark.createDataFrame([(k, *words[k : k + 3]) for k in range(38)], "k int, a string, b string, c string").orderBy("k").select(F.pmod(narrow("a", "b", "c"), F.lit(16))).collect()]
    covered = {j for k, h in enumerate(slots) if slots.count(h) > 1 for j in (k, k + 1, k + 2)}
    assert R.base_counts(own).first()["n_repeat_words"] == len(covered)


def test_distance_equals_numpy(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    out = R.quality_rules(df).toPandas()
    assert out["base_failed"].sum() < len(out) and (out.loc[~out["base_failed"], "distance2"].notna()).all()
    truth = {r["doc_id"]: counts(r["text"]) for r in df.collect()}
    assert all(tuple(r[n] for n in NAMES) == truth[r["doc_id"]] for _, r in out.iterrows())


def test_outliers_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    rows = [(k, " ".join(word() for _ in range(120)), "en", "s") for k in range(120)]
    rows += [(1000 + k, " ".join(word() + "$$$" for _ in range(120)), "en", "s") for k in range(6)]
    out = {r["doc_id"]: r["kept"] for r in R.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[k] for k in range(120)) and not any(out[1000 + k] for k in range(6))


def test_distances_equal_a_numpy_search(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    names, floor = list(R.FEATURES), np.diag([x**2 for x in R.FEATURES.values()])
    data = np.concatenate([rng.multivariate_normal(np.zeros(4), np.diag([0.5, 1, 0.2, 2]) + 0.1, 300), rng.normal(8, 0.5, (40, 4))])
    rows = spark.createDataFrame([(k % 2, *map(float, x)) for k, x in enumerate(data)], "_g long, " + ", ".join(f"{x} double" for x in names))
    estimate = R.robust_estimates(rows)
    got = R._distances(rows, estimate, ("0",)).toPandas()
    held = {r["_g"]: r for r in estimate.collect()}
    for g in (0, 1):
        own = data[g::2]
        best = None
        for _ in range(60):  # random starts, as the textbook has it
            core = own[rng.choice(len(own), 8, replace=False)]
            for _ in range(30):
                centre = core.mean(0)
                scatter = R.CONSISTENCY * np.cov(core.T, bias=True) + floor
                d2 = np.einsum("ij,jk,ik->i", own - centre, np.linalg.inv(scatter), own - centre)
                core = own[np.argsort(d2)[: int(np.ceil(R.MCD_SHARE * len(own)))]]
            det = np.linalg.slogdet(R.CONSISTENCY * np.cov(core.T, bias=True) + floor)[1]
            if best is None or det < best[0]:
                centre = core.mean(0)
                scatter = R.CONSISTENCY * np.cov(core.T, bias=True) + floor
                best = det, np.einsum("ij,jk,ik->i", own - centre, np.linalg.inv(scatter), own - centre)
        found = got[got["_g"] == g]
        factor = np.array([[held[g][f"l0_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        centre = np.array([held[g][f"m0_{i}"] for i in range(4)])
        z = np.linalg.solve(factor, (found[names].to_numpy() - centre).T)
        assert np.allclose(found["_d2_0"], (z * z).sum(0))
        assert 2 * np.log(np.diag(factor)).sum() <= best[0] + 0.02
        verdict = {tuple(x): bool(d > R.CUTOFF) for x, d in zip(own.tolist(), best[1], strict=True)}
        assert all(verdict[tuple(x)] == (d > R.CUTOFF) for x, d in zip(found[names].to_numpy().tolist(), found["_d2_0"], strict=True))


def test_repeats_of_edge_rows(spark):
    out = R.base_counts(docs(spark)).select("text", *NAMES).collect()
    assert all(tuple(r[n] for n in NAMES) == counts(r["text"]) for r in out)


def test_word_vectors_cover_all_texts(spark):
    import pyarrow as pa

    texts = ["alpha beta gamma delta", None, "", "beta alpha", "Gamma beta alpha beta gamma"]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4)
    words, shapes = C.word_vectors(df)
    ends, data = C.buffers(pa.array(texts))
    rows, kinds, bounds = C._rows(data, ends)
    for vectors, seed, own in ((words, 1, rows), (shapes, 7, kinds)):
        index = C._index(len(vectors), seed)
        total = np.zeros(index.shape)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i in range(a, b):
                for j in range(max(a, i - C.WINDOW), min(b, i + C.WINDOW + 1)):
                    total[own[i]] += 3 * index[own[j]] * (i != j)
        assert np.allclose(vectors, C._unit(index, total), atol=1e-5)


def test_native_plan(spark, small):
    plan = op7_quality_rules(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_held_out_quality(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = op8_quality_classifier(spark, small).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.8
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edge_scores(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (99, None)], "doc_id long, quality int")
    for chosen in (labels, labels.limit(0), labels.where("doc_id = 5")):
        model = C.train(docs(spark), chosen, rounds=20)
        out = C.score(docs(spark), model).collect()
        assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["n_words"] == "own" for r in out)
    assert C.score(docs(spark, []), model).count() == 0
    assert C.train(docs(spark, []), labels).layers is None


def test_shapes_and_words_are_counted_alike():
    import pyarrow as pa

    from gridloom.llm.common import buffers

    ends, data = buffers(pa.array(["Ab1 cd!! x", None, "", " AB  éé\n", "z" * 50]))
    words, shapes, bounds = C._rows(data, ends)
    assert len(words) == len(shapes) == 6 and bounds.tolist() == [0, 3, 3, 3, 5, 6]
    assert shapes[2] == shapes[5] and words[2] != words[5]


def test_scores_equal_plain_loops(spark):
    """Pooling, network and temperature a number at a time, with the model's own tables."""
    import math

    import pyarrow as pa

    rng = np.random.default_rng(9)
    good, bad = [f"calm{k} river" for k in range(40)], [f"BUY{k}!! cheap" for k in range(40)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad, rng.integers(3, 30)))) for k in range(160)] + [(900, None), (901, ""), (902, " \n\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    model = C.train(df, labels)
    assert model.layers is not None and model.temperature > 0

    def row_of(word):
        ends, data = C.buffers(pa.array([word]))
        words, shapes, _ = C._rows(data, ends)
        return int(words[0]), int(shapes[0])

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        x = [0.0] * (2 * C.WIDTH)
        for word in words:
            a, b = row_of(word)
            for k in range(C.WIDTH):
                x[k] += float(model.words[a][k]) / len(words)
                x[C.WIDTH + k] += float(model.shapes[b][k]) / len(words)
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        first, bias, second, last = model.layers
        hidden = [math.tanh(sum(x[i] * first[i][j] for i in range(len(x))) + bias[j]) for j in range(len(bias))]
        z = sum(h * w for h, w in zip(hidden, second, strict=True)) + last[0]
        return 1 / (1 + math.exp(-z / model.temperature))

    out = {r["doc_id"]: r["score"] for r in C.score(df, model).collect()}
    assert len(out) == len(rows) and all(abs(out[k] - plain(text)) < 1e-4 for k, text in rows)
    held = [(out[k] > 0.5) == bool(k % 2) for k in range(120, 160)]
    assert sum(held) >= 38


def test_temperature_is_the_likeliest_of_its_grid():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 2.5))).astype(float)

    def loss(t):
        return sum(-np.log(1 / (1 + np.exp(-(a if b else -a) / t))) for a, b in zip(z, y, strict=True))

    best = C._temperature(z, y)
    assert 1.5 < best < 4 and all(loss(best) <= loss(best * s) + 1e-9 for s in (0.8, 0.93, 1.07, 1.25))
