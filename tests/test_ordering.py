import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenledger.operators import ordering


def skewed(spark, n=5000, seed=1):
    """A third of the rows in one group and a third of the values equal."""
    r = np.random.default_rng(seed)
    g = np.where(r.random(n) < 0.34, "hot", np.char.add("g", r.integers(0, 9, n).astype(str)))
    v = np.where(r.random(n) < 0.34, 7.5, np.round(r.normal(0, 100, n), 2))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": r.integers(1, 4, n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_running_total_any_partitioning(spark, partitions):
    pdf, df = skewed(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = ordering.running_total(df.repartition(partitions), ["v", "id"], F.col("w"), ["g"], total="t").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = pdf.sort_values(["g", "v", "id"])
    want["before"] = want.groupby("g")["w"].cumsum() - want["w"]
    want["t"] = want.groupby("g")["w"].transform("sum")
    both = want.merge(got, on="id", suffixes=("", "_got"))
    assert len(both) == len(pdf)
    assert (both["before"] == both["before_got"]).all() and (both["t"] == both["t_got"]).all()


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_dense_ids(spark, partitions):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")).repartition(partitions)
    got = ordering.dense_ids(df, ["k"], "n", start=5).toPandas().sort_values("k")
    assert got["n"].tolist() == list(range(5, 3005))


def test_dense_ids_of_nothing(spark):
    assert ordering.dense_ids(spark.range(0), ["id"], "n").count() == 0


def test_percentiles_with_ties_and_weights(spark):
    pdf, df = skewed(spark)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = ordering.exact_percentiles(df, "v", probs, ["g"], "w").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        flat = np.repeat(part["v"].to_numpy(), part["w"].to_numpy())
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.percentile(flat, 100 * p), abs=1e-9)
    whole = ordering.exact_percentiles(df, "v", probs).first()
    for name, p in probs.items():
        assert whole[name] == pytest.approx(np.percentile(pdf["v"], 100 * p), abs=1e-9)


def test_percentiles_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 5.0)], "g string, v double")
    rows = ordering.exact_percentiles(df, "v", {"m": 0.5}, ["g"]).collect()
    assert [tuple(r) for r in rows] == [("a", 2.0)]


def test_hold_out_sizes_and_stability(spark):
    _, df = skewed(spark, 503)
    once = ordering.hold_out(df, ["id"], 42, strata=["g"]).toPandas()
    again = ordering.hold_out(df.repartition(11), ["id"], 42, strata=["g"]).toPandas()
    for g, part in once.groupby("g"):
        assert part["is_test"].sum() == -(-len(part) // 5)
    assert set(once[once.is_test].id) == set(again[again.is_test].id)
    other = ordering.hold_out(df, ["id"], 43, strata=["g"]).toPandas()
    assert set(once[once.is_test].id) != set(other[other.is_test].id)


@pytest.mark.parametrize("n", [3, 5, 12, 101])
def test_contiguous_folds(spark, n):
    got = ordering.contiguous_folds(spark.range(n), ["id"], 5).toPandas().sort_values("id")["fold"].tolist()
    want = [f for f, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]
    assert got == want


def test_hash_split_is_each_rows_own(spark):
    df = spark.range(4000)
    got = {r.id: r.is_test for r in ordering.hash_split(df, ["id"], 42).collect()}
    assert 700 < sum(got.values()) < 900
    some = {r.id: r.is_test for r in ordering.hash_split(df.where("id % 3 = 0").repartition(5), ["id"], 42).collect()}
    assert all(got[i] == t for i, t in some.items())
    assert "Exchange" not in ordering.hash_split(df, ["id"], 42)._jdf.queryExecution().toString()
    assert ordering.hash_split(df, ["id"], 42, 0.0).where("is_test").count() == 0
    assert ordering.hash_split(df, ["id"], 42, 1.0).where("is_test").count() == 4000


def test_running_total_moves_rows_once(spark):
    """One exchange by range; numbers far beyond a partition's rows and batches stay exact."""
    df = spark.range(30_000).selectExpr("id", "id % 3 g", "id * 1000003 w")
    got = ordering.running_total(df, ["id"], F.col("w"), ["g"], total="t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan
    rows = got.toPandas().sort_values(["g", "id"])
    assert (rows["before"] == rows.groupby("g")["w"].cumsum() - rows["w"]).all()
    assert (rows["t"] == rows.groupby("g")["w"].transform("sum")).all()
