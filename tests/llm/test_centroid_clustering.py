"""Centroid clustering against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from gridloom.llm.centroid_clustering import Annulus, centroid_clusters


def brute(rows, k, rounds, scale, dims):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else v for c, v in enumerate(now)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, by[c], sum(by.values()), names[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("k,rounds", [(4, 3), (1, 0), (40, 2)])
def test_equals_plain_integers(spark, k, rounds):
    random = np.random.default_rng(k)
    rows = [(i, random.integers(-40, 40, 3).astype(np.float32).tolist() if i % 3 else (random.random(3) * 4 - 2).astype(np.float32).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, [9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0]), (900, None), (901, [1.0, None, 2.0]), (902, [1.0, 2.0]), (903, []), (904, [float("nan"), 1.0, 2.0]), (905, [float("inf"), 1.0, 2.0])]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]  # a third of the rows are one vector
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    out = centroid_clusters(df, k=k, rounds=rounds, scale=8, dims=3)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, k, rounds, 8, 3)


def test_few_rows_none_and_too_large(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroid_clusters(spark.createDataFrame([], kind), dims=2).count() == 0
    assert centroid_clusters(spark.createDataFrame([(None, [1.0, 2.0])], kind), dims=2).count() == 0  # no row can be a first centroid
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5])]
    assert sorted(map(tuple, centroid_clusters(spark.createDataFrame(rows, kind), dims=2).collect()), key=str) == brute(rows, 16, 3, 64, 2)
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(spark.createDataFrame([(1, [1e12, 0.0])], kind), dims=2).count()


def test_annulus_holds_every_nearest_and_its_ties():
    random = np.random.default_rng(3)
    centroids = random.integers(-5, 6, (50, 2))  # many equal norms and equal centroids
    vectors = random.integers(-6, 7, (2000, 2))
    find = Annulus(centroids)
    best, least = find.nearest(vectors)
    all_d = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (least == all_d.min(1)).all()
    assert (best == all_d.argmin(1)).all()
    low, high = find.candidates((vectors**2).sum(1), least)
    for v in range(len(vectors)):
        assert set(np.flatnonzero(all_d[v] == least[v])) <= set(find.order[low[v] : high[v]])
    assert (high - low).mean() < 40  # and leaves others out


def test_query_equals_its_sql(spark, small):
    import duckdb

    from gridloom.llm.queries import ORACLES, QUERIES

    name = "op11_centroid_clustering"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = con.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, small).select(*columns).collect())) == sorted(want.fetchall())
