import random

from edge import docs
from hypothesis import given, settings, strategies as st

from gridloom.llm import decontamination as D


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return min(row)


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_bit_parallel_distance(item, text):
    assert D.edit_distance_within(item, text) == distance(item, text)


@given(st.text("ab", min_size=1, max_size=40), st.text("ab", max_size=60), st.sampled_from([0.0, 0.1, 0.3]))
@settings(max_examples=300, deadline=None)
def test_pigeonhole_finds_all_within_budget(item, text, rate):
    item, text = D.normal(item), D.normal(text)
    items = [(7, item)]
    automaton = D._automaton(items, rate)
    got = D.matches(text, items, automaton, rate) if item else {}
    want = distance(item, text)
    assert got == ({0: want} if want <= D.budget(item, rate) else {})


def test_planted_items(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(25)) for k in range(10)] + [(10, None), (11, ""), (12, "  \n ")]
    rows = []
    for k in range(60):
        body = text(200)
        if k < 10:
            own = list(items[k][1])
            for _ in range(k):
                own[rng.randrange(len(own))] = "#"
            body = body[:300] + " \n" + "".join(own).upper() + "\t " + body[300:]
        rows.append((k, body, "en", "s"))
    found = D.benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    assert got == {(k, k): e for k in range(10) if (e := distance(D.normal(items[k][1]), D.normal(rows[k][1]))) <= D.budget(items[k][1], 0.06)}
    assert len(got) >= 7


def test_edge_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "hello WIDE world, this is"), (2, None), (3, "beta gamma delta. alpha beta")], "item_id long, text string")
    want = sorted([(3, 1, 0), (3, 1, 0), (5, 3, 0), (6, 3, 0)])
    assert sorted(map(tuple, D.benchmark_matches(docs(spark), bench).collect())) == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    assert sorted(map(tuple, D.benchmark_matches(docs(spark), bench).collect())) == want
    assert D.benchmark_matches(docs(spark), bench.limit(0)).count() == 0
    assert D.benchmark_matches(docs(spark, []), bench).count() == 0
    left = D.decontaminated(docs(spark), bench)
    assert left.columns == docs(spark).columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "7", "8", "None"]


def test_blocks_have_names_of_their_own():
    one, two = [(1, "a"), (2, "b")], [(1, "a"), (2, "c")]
    assert len({D.content_key(x, r) for x in (one, two, one[:1], []) for r in (0.06, 0.1)}) == 8
    assert D.content_key(one, 0.06) == D.content_key(list(one), 0.06)


def test_many_long_texts_in_one_batch(spark):
    item = "a passage of the benchmark that stands somewhere in a long text"
    rows = [(k, "filler words " * 20_000 + (item if k % 3 == 0 else "") + " and more" * 500) for k in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = D.benchmark_matches(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(k, 9, 0) for k in range(0, 45, 3)]
