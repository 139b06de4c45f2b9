import numpy as np
import pytest
from pyspark.sql import functions as F

from greenledger.llm import neighbours, queries


def brute(rows, queries_of, k):
    ids = np.array([i for i, _ in rows])
    points = np.array([p for _, p in rows], np.float32).astype(float)
    out = {}
    for i, p in zip(ids, points):
        if queries_of(i):
            distance = np.sqrt(((points - p) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((ids, distance)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), distance[j]) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_table_is_exact(frame):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # many copies of one vector
    df = frame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("ids", F.lit(2))
    got = found(neighbours.nearest(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0, 10)


def test_rows_that_take_no_part(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 2.0]), (1, [1.0, 3.0])]
    df = frame(rows, "vec_id long, embedding array<float>")
    assert found(neighbours.nearest(df, F.lit(True))) == {0: [(1, 1.0)], 1: [(0, 1.0)]}
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).collect() == []
    assert neighbours.nearest(df.limit(0), F.lit(True)).collect() == []


def test_leaves_are_searched_through_one_queue():
    points = np.random.default_rng(3).normal(size=(2000, 8))
    forest = neighbours.grow(points, 4, 5)
    leaves = forest.leaves(points)
    for i in range(20):
        walk = forest.search(points[i], 40)
        assert len(set(walk)) == len(walk) == 40
        assert set(leaves[i]) <= set(walk)  # the point's own leaf of every tree comes first
    assert sorted(forest.search(points[0], 10**6)) == list(range(4 * 32))


@pytest.mark.parametrize("copies", [0, 9000])
def test_recall(spark, frame, copies):
    """With and without a vector that most rows share; ties and distances are exact either way."""
    r = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(6000, 24)).astype(np.float32))]
    rows += [(10_000 + i, rows[0][1]) for i in range(copies)]
    got = found(neighbours.nearest(frame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 200 == 0))
    want = brute(rows, lambda i: i % 200 == 0, 10)
    assert got.keys() == want.keys()
    hits = [len(set(got[q]) & set(want[q])) / 10 for q in want]
    assert np.mean(hits) >= 0.9


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found(queries.op8_neighbours(spark, sf_dir))
    want = brute(rows, lambda i: i % 100 == 0, 10)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
