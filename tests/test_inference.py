import numpy as np
import pytest

from greenledger.functions import numerics
from greenledger.operators import inference

SETS = {
    "plain": ([1.5, 2.5, 9.0, 4.25, 6.0], [3.0, 8.0, 7.5]),
    "ties": ([1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 3.0, 5.0, 8.0]),
    "long": ([float(i * 7 % 31) for i in range(12)], [float(i * 5 % 29) + 0.5 for i in range(10)]),
    "same": ([4.0, 4.0, 4.0], [4.0, 4.0, 4.0]),
}


def pair_of(spark, a, b):
    rows = [("a", v, 1) for v in a] + [("b", v, 1) for v in b]
    return spark.createDataFrame(rows, "side string, measured_value double, copies bigint")


@pytest.mark.parametrize("name", SETS)
def test_mann_whitney(spark, name):
    a, b = SETS[name]
    got = inference.mann_whitney(pair_of(spark, a, b)).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    _, t = np.unique(a + b, return_counts=True)
    assert got.u_a == u and got.u_a + got.u_b == len(a) * len(b)
    assert got.tie_term == (t**3 - t).sum()
    assert got.p == pytest.approx(numerics.rank_test_p(u, len(a), len(b), float((t**3 - t).sum())))


@pytest.mark.parametrize("name", ["plain", "ties", "long"])
def test_welch_and_levene(spark, name):
    a, b = (np.array(x) for x in SETS[name])
    got = inference.welch(pair_of(spark, a.tolist(), b.tolist())).first()
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    assert got.t == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb)) and got.df == pytest.approx(df)
    assert got.p == pytest.approx(numerics.t_two_sided(got.t, df))
    assert got.decision == ("reject" if got.p < 0.05 else "keep")
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    n, z = len(a) + len(b), np.concatenate([za, zb])
    between = len(a) * (za.mean() - z.mean()) ** 2 + len(b) * (zb.mean() - z.mean()) ** 2
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    lev = inference.levene(pair_of(spark, a.tolist(), b.tolist())).first()
    assert lev.w == pytest.approx((n - 2) * between / within)
    assert lev.p == pytest.approx(numerics.f_upper(lev.w, 1, n - 2))


def test_weights_count_as_rows(spark):
    rows = [("a", 1.0, 2), ("a", 5.0, 1), ("b", 2.0, 3), ("b", 9.0, 1), ("b", 1.0, 1)]
    weighted = spark.createDataFrame(rows, "side string, measured_value double, copies bigint")
    flat = pair_of(spark, [1.0, 1.0, 5.0], [2.0, 2.0, 2.0, 9.0, 1.0])
    for test in (inference.welch, inference.levene, inference.mann_whitney):
        assert [x for x in test(weighted).first()] == pytest.approx([x for x in test(flat).first()])


def test_too_few_values(spark):
    pair = pair_of(spark, [1.0, 2.0], [1.0, 2.0, 3.0])
    for test in (inference.welch, inference.levene, inference.mann_whitney):
        assert test(pair).count() == 0


def test_constant_groups_give_no_statistic(spark):
    got = inference.welch(pair_of(spark, *SETS["same"])).first()
    assert got.t is None and got.p is None and got.decision is None
    with pytest.raises(ValueError):
        inference.compare_sectors(None, "x", "x")
