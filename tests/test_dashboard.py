"""Weighted statistics against the fully multiplied rows, on names shared by several companies."""

from datetime import date

import numpy as np
import pandas as pd
import pytest

from greenledger.operators import profile
from greenledger.operators.dashboard import build_dashboard
from greenledger.schema import METRIC_NAMES, PILLARS, TABLES
from greenledger.sources.seed import seed_tables


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    n = 60
    company = pd.DataFrame(
        {
            "company_id": np.arange(n),
            # A third of the companies share one name, and some share the sector as well.
            "trade_name": np.where(np.arange(n) % 3 == 0, "Shared", np.char.add("C", (np.arange(n) // 2).astype(str))),
            "tax_id": np.arange(n).astype(str),
            "city": "X",
            "industry": [None if i % 11 == 5 else f"S{i % 4}" for i in range(n)],
            "parent_company_id": None,
        }
    )
    m = 3000
    owner = np.where(r.random(m) < 0.34, 9, r.integers(0, n - 5, m))
    reading = pd.DataFrame(
        {
            "reading_id": np.arange(m),
            "read_at": pd.Timestamp("2022-01-30") + pd.to_timedelta(r.integers(0, 100 * 24, m), "h"),
            "measured_value": np.where(r.random(m) < 0.02, 99999.5, np.round(r.gamma(2.0, 200.0, m), 2)),
            "status": r.choice(["PENDING", "VALIDATED", "REJECTED"], m),
            "site_id": 1,
            "company_id": owner,
            "metric_id": r.integers(1, 5, m),
        }
    )
    frames = {
        "company": spark.createDataFrame(company.astype(object).where(company.notna(), None), TABLES["company"].schema),
        "reading": spark.createDataFrame(reading, TABLES["reading"].schema),
        **seed_tables(spark),
    }
    base = build_dashboard(frames["reading"], frames["company"], frames["metric"], frames["category"])
    pillar = {1: PILLARS[0], 2: PILLARS[1], 3: PILLARS[2], 4: PILLARS[2]}
    full = reading.merge(company[["company_id", "trade_name"]], on="company_id")
    full = full.merge(company[["trade_name", "industry"]], on="trade_name")
    full["pillar"] = full["metric_id"].map(pillar)
    full["metric_name"] = full["metric_id"].map(lambda i: METRIC_NAMES[i - 1])
    return base, full, frames


def frame(df, *keys):
    out = df.toPandas()
    return out.set_index(list(keys)).sort_index() if keys else out.iloc[0]


def test_copies_are_used(data):
    base, full, _ = data
    rows = base.rows.toPandas()
    assert rows["copies"].max() > 1 and rows["copies"].sum() == len(full) and len(rows) < len(full)


def test_counts_and_means(data):
    base, full, _ = data
    got = frame(profile.count_by(base, "industry", "status"), "industry", "status")["readings"]
    want = full.groupby(["industry", "status"]).size()
    assert (got == want).all() and len(got) == len(want)
    got = frame(profile.mean_by(base, "pillar"), "pillar")["mean_value"]
    np.testing.assert_allclose(got, full.groupby("pillar")["measured_value"].mean())


def test_moments(data):
    base, full, _ = data
    x = full["measured_value"].to_numpy()
    got = frame(profile.moments(base))
    d = x - x.mean()
    assert got["readings"] == len(x)
    np.testing.assert_allclose(
        [got["mean_value"], got["variance"], got["sd"], got["skewness"], got["kurtosis"]],
        [x.mean(), x.var(ddof=1), x.std(ddof=1), (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3],
        rtol=1e-10,
    )
    grouped = frame(profile.moments(base, "industry", "pillar"), "industry", "pillar")["sd"]
    np.testing.assert_allclose(grouped, full.groupby(["industry", "pillar"])["measured_value"].std(), rtol=1e-10)


def test_moments_of_a_far_narrow_group(spark):
    from greenledger.operators.moments import weighted_moments

    rows = [("far", 1e9 + i % 7, 1 + i % 3) for i in range(300)] + [("near", float(i), 1) for i in range(10)]
    got = weighted_moments(spark.createDataFrame(rows, "g string, v double, w bigint"), "v", "w", ["g"]).toPandas().set_index("g")
    x = np.repeat([v for g, v, _ in rows if g == "far"], [w for g, _, w in rows if g == "far"])
    assert got.loc["far", "variance"] == pytest.approx((x - 1e9).var(ddof=1), rel=1e-6)


def test_single_row_interval(data):
    base, full, frames = data
    own = build_dashboard(frames["reading"], frames["company"], frames["metric"], frames["category"], key="company_id")
    row = frame(profile.mean_interval(own.where_facts("reading_id = 1")))
    assert row["readings"] == 1 and row["ci_low"] == row["ci_high"] == row["mean_value"]
    assert pd.isna(frame(profile.moments(own.where_facts("reading_id = 1")))["sd"])


def test_median_mode_box(data):
    base, full, _ = data
    got = frame(profile.medians(base, "industry"), "industry")["median"]
    np.testing.assert_allclose(got, full.groupby("industry")["measured_value"].median())
    mode = frame(profile.mode(base))
    counts = full["measured_value"].round(1).value_counts()
    best = counts[counts == counts.max()].index.min()
    assert (mode["mode_value"], mode["n"]) == (best, counts.max())
    box = frame(profile.box_summary(base, "pillar"), "pillar")
    rows = profile.box_outliers(base).toPandas()
    assert len(rows)
    for pillar, part in full.groupby("pillar"):
        v = part["measured_value"]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        inside = v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        assert box.loc[pillar, "outliers"] == (~inside).sum() == rows[rows.pillar == pillar]["copies"].sum()
        assert box.loc[pillar, "whisker_high"] == v[inside].max() and box.loc[pillar, "whisker_low"] == v[inside].min()


def test_distinct_pivot_correlation(data):
    base, full, _ = data
    got = frame(profile.distinct_counts(base))
    assert (got["companies"], got["industries"]) == (full["trade_name"].nunique(), full["industry"].nunique())
    wide = full.pivot_table(index="trade_name", columns="pillar", values="measured_value", aggfunc="mean").dropna()
    ours = frame(profile.pillar_means(base, "trade_name"), "trade_name")
    np.testing.assert_allclose(ours[[p.lower() for p in PILLARS]], wide[list(PILLARS)])
    corr = wide.corr().round(3)
    for r in profile.pillar_correlations(base).collect():
        assert r.r == pytest.approx(corr.loc[r.pillar_a, r.pillar_b])
    assert profile.pillar_correlations(base.filter(companies=["Shared", "C1"])).count() == 0
    heat = frame(profile.sector_metric_heat(base, 2), "industry")
    top = full["industry"].value_counts()
    assert set(heat.index) == set(top.index[:2])


def test_filters(data):
    base, full, _ = data
    a, b = date(2022, 2, 3), date(2022, 3, 4)
    got = frame(profile.counted(base.filter(first_day=a, last_day=b, statuses=["PENDING"], companies=["Shared"])))
    kept = full[(full.read_at.dt.date >= a) & (full.read_at.dt.date <= b) & (full.status == "PENDING") & (full.trade_name == "Shared")]
    assert got["readings"] == len(kept) > 0
    nothing = frame(profile.counted(base.filter(companies=["nobody"])))
    assert nothing["readings"] == 0 and pd.isna(nothing["validated_percent"])
    assert profile.summary(base.filter(companies=["nobody"])).first()["readings"] == 0


def test_id_key_has_no_fan_out(data):
    _, full, frames = data
    base = build_dashboard(frames["reading"], frames["company"], frames["metric"], frames["category"], key="company_id")
    assert frame(profile.counted(base))["readings"] == 3000


def test_histogram_and_spans(data):
    base, full, _ = data
    got = profile.histogram(base, 30).toPandas()
    assert got["readings"].sum() == len(full) and got["bin"].min() == 1 and got["bin"].max() == 30
    span = frame(profile.date_span(base))
    assert (span["first_read"], span["last_read"]) == (full.read_at.min(), full.read_at.max())


@pytest.mark.parametrize("task_rows", [1_000_000, 0])
@pytest.mark.parametrize("kind", ["normal", "heavy tails", "few values", "constant", "odd"])
def test_selection_is_exact_for_any_distribution(spark, monkeypatch, kind, task_rows):
    """Quantiles, whiskers and outliers against numpy over the multiplied rows, by a window and by ranges."""
    import numpy as np

    from greenledger.operators import selection
    from greenledger.operators.dashboard import Dashboard

    monkeypatch.setattr(selection, "TASK_ROWS", task_rows)
    r = np.random.default_rng(3)
    n = 600
    v = {
        "normal": r.normal(50, 20, n), "heavy tails": np.exp(r.normal(0, 8, n)) * r.choice([-1, 1], n),
        "few values": r.integers(0, 4, n).astype(float), "constant": np.full(n, 7.25),
        "odd": np.where(r.random(n) < 0.1, 1e300, np.where(r.random(n) < 0.1, -1e-300, r.normal(0, 1e-9, n))),
    }[kind]
    company = r.integers(0, 12, n)
    facts = spark.createDataFrame([(int(c), float(x), "EN"[int(c) % 2]) for c, x in zip(company, v)] + [(1, None, "E")],
                                  "company_id long, measured_value double, pillar string")
    copies = [(c, f"s{s}", 1 + (c + s) % 3) for c in range(10) for s in range(2) if (c + s) % 4]
    labels = spark.createDataFrame(copies, "company_id long, industry string, copies long")
    base = Dashboard(facts, labels)
    rows = [("EN"[c % 2], s, x) for c, x in zip(company, v) for i, s, k in copies if i == c for _ in range(k)]
    for keys, of in ((("pillar", "industry"), lambda t: (t[0], t[1])), ((), lambda t: ())):
        groups = {}
        for t in rows:
            groups.setdefault(of(t), []).append(t[2])
        got = {tuple(b[k] for k in keys): b for b in selection.Bins(base, keys).boxes().collect()}
        assert got.keys() == groups.keys()
        for key, values in groups.items():
            values, b = np.array(values), got[key]
            q1, median, q3 = np.percentile(values, [25, 50, 75])
            assert [b.q1, b.median, b.q3] == pytest.approx([q1, median, q3], rel=1e-12, abs=1e-300)
            inside = values[(values >= b.q1 - (b.q3 - b.q1) * 1.5) & (values <= b.q3 + (b.q3 - b.q1) * 1.5)]
            assert (b.whisker_low, b.whisker_high, b.outliers) == (inside.min(), inside.max(), len(values) - len(inside))


def test_approximate_median_between_two_bins(spark):
    """The middle of an even number of values lies between two bins, however far apart, or within one."""
    from greenledger.operators import profile
    from greenledger.operators.dashboard import Dashboard

    groups = {"apart": [1.0, 10.0, 100.0, 1000.0], "two": [3.0, 5.0], "one": [7.0], "odd": [1.0, 2.0, 50.0], "same": [4.0] * 4}
    facts = spark.createDataFrame(
        [(i, x) for i, values in enumerate(groups.values()) for x in values], "company_id long, measured_value double"
    )
    labels = spark.createDataFrame([(i, g, 2) for i, g in enumerate(groups)], "company_id long, industry string, copies long")
    got = {r.industry: r.median for r in profile.approximate_medians(Dashboard(facts, labels), "industry").collect()}
    assert got == pytest.approx({"apart": 55.0, "two": 4.0, "one": 7.0, "odd": 2.0, "same": 4.0})


@pytest.mark.parametrize("values, total", [
    ([2e16, 1.0], 2e16 + 1), ([9e15] * 20, 1.8e17), ([4e-11, 2e-11], 6e-11), ([1e11, -1e11, 0.1, 0.2], 0.3),
    ([float("nan"), 1.5], 1.5), ([None], None), ([], None), ([1e300, 1e300], 2e300), ([float("inf"), 1.0], float("inf")),
])
def test_sums_of_any_size(spark, values, total):
    """Neither large nor very small addends raise or get lost, weighted or not."""
    from greenledger.functions.columns import exact_mean, exact_sum
    from greenledger.operators.moments import weighted_moments

    df = spark.createDataFrame([(v, 3) for v in values], "v double, w long")
    got = df.agg(exact_sum("v").alias("s"), exact_mean("v", "w").alias("m")).first()
    counted = [v for v in values if v is not None and v == v]
    if total is None:
        assert got.s is None and got.m is None
        return
    assert got.s == pytest.approx(total, rel=1e-12) and got.m == pytest.approx(total / len(counted), rel=1e-12)
    if total < 1e300:
        assert weighted_moments(df, "v", "w").first()["mean"] == pytest.approx(total / len(counted), rel=1e-12)


def test_weights_beyond_decimals(spark):
    from pyspark.sql import functions as F

    from greenledger.functions.columns import weighed_parts, whole_sum

    df = spark.sql("select cast(1.5 as decimal(31,10)) s, 0.25D e, 20000000L w union all select null, 2D, 3L")
    near, rest = weighed_parts(F.col("s"), F.col("e"), "w")
    assert [r[0] for r in df.select(whole_sum(near, rest)).collect()] == [3.5e7, 6.0]


def test_summaries_scan_the_facts_twice(data, tmp_path, spark):
    """The parts of all figures come from one pass, the values around the medians from a second one."""
    base, _, frames = data
    frames["reading"].write.parquet(str(tmp_path / "reading"))
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    stored = spark.read.parquet(str(tmp_path / "reading"))
    counted = build_dashboard(stored.mapInArrow(seen, stored.schema), frames["company"], frames["metric"], frames["category"])
    for build in (profile.summary, profile.sector_pillar_summary):
        start = passes.value
        got = build(counted).toPandas()
        assert (passes.value - start) <= 2 * stored.count() and len(got)
        by = [c for c in ("industry", "pillar") if c in got]
        want = build(base).toPandas()
        if by:
            got, want = (x.sort_values(by, ignore_index=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_company_sketches_unite(data):
    """Months unite to any span under the filters; a company seen in several of them counts once."""
    from pyspark.sql import functions as F

    from greenledger.operators.sketches import company_sketches, distinct_companies

    base, full, _ = data
    kept = company_sketches(base).cache()
    assert distinct_companies(kept).first()[0] == full["trade_name"].nunique()
    spring = (F.col("month") >= "2022-02") & (F.col("month") <= "2022-03") & (F.col("status") == "PENDING")
    part = full[(full["read_at"] >= "2022-02-01") & (full["read_at"] < "2022-04-01") & (full["status"] == "PENDING")]
    want = part.groupby("industry")["trade_name"].nunique().to_dict()
    got = {r.industry: r.companies for r in distinct_companies(kept, "industry", where=spring).collect()}
    assert got == want
    assert distinct_companies(kept, where=F.col("month") == "1900-01").first()[0] == 0
    assert distinct_companies(kept, "pillar", where=F.lit(False)).collect() == []
