"""Shared helpers: batches, filters, settings."""

import numpy as np
import pyarrow as pa
from edge import docs

from gridloom.llm.common import BATCH_KEY, in_arrow, materialize, parts
from gridloom.llm.filters import bits_for, key_filter, may_hold
from gridloom.llm.line_dedup import line_dedup


def test_parts_are_bounded_and_whole():
    texts = ["x" * n for n in (0, 10, 5000, 3, 3, 3, 9000, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(9)), "list": pa.array([[1, 2]] * 9)})
    got = list(parts(batch, 4000))
    assert [t for p in got for t in p.column("text").to_pylist()] == texts
    assert len(got) > 2 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 4000 for p in got)
    assert list(parts(batch.slice(0, 0))) == [batch.slice(0, 0)]


def test_a_task_is_given_bounded_parts_of_a_long_batch(spark):
    df = spark.createDataFrame([(k, "word " * 40_000) for k in range(60)], "k long, text string").coalesce(1)  # 12 MB

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64())})

    rows = [r["rows"] for r in in_arrow(df, sizes, "rows long").collect()]
    assert sum(rows) == 60 and max(rows) <= 21


def test_operators_leave_the_session_as_it_is(spark):
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.unset(BATCH_KEY)
    try:
        line_dedup(docs(spark), min_docs=2).count()
        assert spark.conf.get(BATCH_KEY, None) is None
        spark.conf.set(BATCH_KEY, "1m")
        materialize(docs(spark), "own").count()
        assert spark.conf.get(BATCH_KEY) == "1m"
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)


def test_filter_holds_its_keys_and_few_others(spark):
    random = np.random.default_rng(1)
    keys = random.integers(-(1 << 63), 1 << 63, 200_000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "id long").repartition(5)
    filled = key_filter(df, bits_for(len(keys)))
    assert may_hold(filled, keys.view(np.uint64)).all()
    assert may_hold(filled, random.integers(0, 1 << 63, 200_000).astype(np.uint64)).mean() < 0.02
    assert not key_filter(df.limit(0), bits_for(0)).any()
