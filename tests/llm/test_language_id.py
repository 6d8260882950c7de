import random

from edge import docs
from pyspark.sql import functions as F

from gridloom.llm import language_id as L
from gridloom.llm.queries import op3_language_id


def test_held_out_accuracy(spark, small):
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    out = op3_language_id(spark, small).join(truth, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_edge_rows(spark):
    out = L.predict(docs(spark), L.train(docs(spark), least_share=0.0)).collect()
    assert len(out) == 10
    for r in out:
        assert 0 <= r["score"] <= 1
        letter = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letter)
        assert r["n_words"] == "own"


def test_nothing_to_learn_from(spark):
    model = L.train(docs(spark, []))
    assert {r["lang_pred"] for r in L.predict(docs(spark), model).collect()} == {"und"}
    assert L.predict(docs(spark, []), model).count() == 0
    assert L.known_language(docs(spark, [])).columns == docs(spark, []).columns


def test_filter_has_no_false_negatives_and_its_rate_is_known():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    grams, _ = L._grams([" ".join(words)], 5)
    import numpy as np

    slots = np.zeros(L.SLOTS, np.uint8)
    for at in L._slots(grams):
        slots[at] |= 1
    model = L.LanguageModel(["x"], [slots], np.array([float((slots & 1).mean()) ** 2]))
    assert (slots[L._slots(grams)[0]] & slots[L._slots(grams)[1]] & 1).all()
    fresh = np.random.default_rng(1).integers(0, 1 << 62, 200_000, dtype=np.uint64)
    hit = (slots[L._slots(fresh)[0]] & slots[L._slots(fresh)[1]] & 1).mean()
    assert abs(hit - model.wrong[0]) < 2e-4


def test_grams_and_scores_equal_those_of_the_text_alone():
    import numpy as np

    texts = ["One two", "", "Drei, vier!", "x", "ja", "--", "Straße", "no", "a b c d e f"]
    for size in L.GRAMS:
        together, stops = L._grams(texts, size)
        assert len(stops) == len(texts) and stops[-1] == len(together)
        for text, begin, stop in zip(texts, [0, *stops], stops, strict=False):
            assert together[begin:stop].tolist() == L._grams([text], size)[0].tolist()
    own = L._grams(["ja"], 3)[0]
    assert len(own) == 2  # " ja" and "ja "
    slots = np.zeros(L.SLOTS, np.uint8)
    for at in L._slots(own):
        slots[at] |= 1
    model = L.LanguageModel(["x"], [slots], np.array([0.0]))
    for near in (["ja"], ["ja", "other words"], ["other words", "ja"], ["jam", "ja", "jar"]):
        assert L._classify(near, model)[1][near.index("ja")] == 1.0


def test_every_labelled_language_is_told_apart(spark):
    rng = random.Random(4)
    rows = []
    for k in range(140):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)]
        rows += [(len(rows) + j, " ".join(words), f"l{k:03}", "s") for j in range(2 + k % 2)]
    df = docs(spark, rows)
    model = L.train(df)
    assert model.languages == sorted({r[2] for r in rows}) and len(model.slots) == 3
    out = L.predict(df, model).select("lang", "lang_pred", "score").collect()
    assert len(out) == len(rows) and all(r["lang"] == r["lang_pred"] and r["score"] > 0.9 for r in out)
    assert L.known_language(df).count() > 0.9 * len(rows)


def plain_grams(text, size):
    """The n-grams of bytes by the definition: letters lower-cased, everything else one space, a space at both ends."""
    import re

    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {text.lower()} ".encode())
    return [raw[k : k + size] for k in range(len(raw) - size + 1)]


def test_predictions_equal_exact_sets(spark, small, monkeypatch):
    """With exact sets in place of the filters: the share of a text's n-grams that each language's set holds."""
    df = spark.read.parquet(f"{small}/documents.parquet").where("text is not null and lang is not null").limit(150)
    rows = df.select("text", "lang").collect()
    model = L.train(df, least_share=0.004)
    count, docs_of = {}, {}
    for text, lang in rows:
        docs_of[lang] = docs_of.get(lang, 0) + 1
        for gram in {g for size in L.GRAMS for g in plain_grams(text, size)}:
            count[lang, gram] = count.get((lang, gram), 0) + 1
    need = {x: max(min(3, -(-n // 5)), 0.004 * n) for x, n in docs_of.items()}
    sets = {x: {g for (y, g), n in count.items() if y == x and n >= need[x]} for x in docs_of}
    out = L.predict(df, model).select("text", "lang_pred", "score").collect()
    close = 0
    for text, lang, score in out:
        grams = [g for size in L.GRAMS for g in plain_grams(text, size)]
        shares = {x: sum(g in own for g in grams) / max(1, len(grams)) for x, own in sets.items()}
        if any(map(str.isalpha, text)):
            assert abs(score - shares[lang]) < 0.02
            assert shares[lang] > max(shares.values()) - 0.02
            close += lang == max(sorted(shares), key=shares.get)
    assert close > 0.95 * len(out)


def test_counts_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    import pyarrow as pa

    texts = [f"some words of text number {k} and more" for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "lang": pa.array(["en", "fr"] * 15)})
    sums = {}
    for out in L._count(iter([batch])):
        for lang, gram, n in zip(*(out.column(x).to_pylist() for x in ("lang", "gram", "n")), strict=True):
            sums[lang, gram] = sums.get((lang, gram), 0) + n
    monkeypatch.setattr(L, "HELD", 1 << 30)
    whole = {}
    for out in L._count(iter([batch])):
        for lang, gram, n in zip(*(out.column(x).to_pylist() for x in ("lang", "gram", "n")), strict=True):
            whole[lang, gram] = n
    assert sums == whole and sums["en", None] == 15
