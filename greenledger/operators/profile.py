"""Statistics of the dashboards over a ``Dashboard``. Keys that are NULL form no group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import CRITICAL_IMPACT, LOW_IMPACT, MODERATE_IMPACT, impact_class, month_of, one_place, whole_sum
from ..functions.numerics import t_quantile_udf
from ..schema import METRIC_NAMES, PILLARS
from ..session import checkpointed
from .dashboard import VALUE, W, Dashboard, keep_most_frequent, merge_totals
from .moments import merge_moments, partial_moments
from .rows import side_by_side, sized_broadcast
from .selection import BIN, QUARTILES, Bins, log_bin, percentiles


def _count(when: Column | None = None) -> Column:
    n = F.col("n") if when is None else F.when(when, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def _mean(when: Column | None = None) -> Column:
    """Mean from totals: exact sum over count, optionally of the groups that meet a condition."""
    s, e, c = (F.sum(F.col(x) if when is None else F.when(when, F.col(x))) for x in ("s", "e", "c"))
    # A condition that no group meets leaves NULL / NULL.
    return F.try_divide(whole_sum(s, e), c.cast("double"))


def _percent(when: Column) -> Column:
    return F.try_divide(F.lit(100.0) * _count(when).cast("double"), F.sum("n").cast("double"))


def count_by(base: Dashboard, *keys: str) -> DataFrame:
    return base.totals(*keys).select(*keys, F.col("n").alias("readings"))


def mean_by(base: Dashboard, *keys: str) -> DataFrame:
    mean = F.try_divide(whole_sum(F.col("s"), F.col("e")), F.col("c").cast("double"))
    return base.totals(*keys).select(*keys, mean.alias("mean_value"))


def mean_by_month_and_pillar(base: Dashboard) -> DataFrame:
    return mean_by(base.with_facts(month=month_of("read_at")), "month", "pillar")


def share_by(base: Dashboard, key: str) -> DataFrame:
    """Count per value of ``key`` and its percentage of all counted rows."""
    counts = count_by(base, key)
    total = counts.agg(F.sum("readings"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("readings") / total.scalar())


def counted(base: Dashboard) -> DataFrame:
    """Rows and validated share; an empty base gives one row of 0 and NULL."""
    return _validated(base.totals("status"))


def _validated(totals: DataFrame) -> DataFrame:
    return totals.agg(_count().alias("readings"), _percent(F.col("status") == "VALIDATED").alias("validated_percent"))


def date_span(base: Dashboard) -> DataFrame:
    """First and last reading, from the span of each company."""
    spans = base.facts.groupBy("company_id").agg(F.min("read_at").alias("a"), F.max("read_at").alias("b"))
    known = spans.join(base.labels.select("company_id").distinct(), "company_id", "left_semi")
    return known.agg(F.min("a").alias("first_read"), F.max("b").alias("last_read"))


def distinct_counts(base: Dashboard, approximate: float | None = None) -> DataFrame:
    """Distinct names and sectors with readings. ``approximate`` is a relative error to trade for one pass."""
    return _distinct_labels(base, base.facts.select("company_id").distinct(), approximate)


def _distinct_labels(base: Dashboard, companies: DataFrame, approximate: float | None = None) -> DataFrame:
    used = base.labels.join(companies, "company_id", "left_semi")
    if approximate:
        return used.agg(
            F.approx_count_distinct("trade_name", approximate).alias("companies"),
            F.approx_count_distinct("industry", approximate).alias("industries"),
        )
    # One distinct per column: several in one aggregation would copy each row once per column.
    return used.sparkSession.range(1).select(
        *[
            used.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar().alias(n)
            for n, c in (("companies", "trade_name"), ("industries", "industry"))
        ]
    )


def moments(base: Dashboard, *keys: str) -> DataFrame:
    """n, mean, sample variance and sd, biased skewness and excess kurtosis.

    The facts are combined per company first, so one row per company and fact key meets the labels.
    """
    return _named_moments(base.per_company(lambda facts, by: partial_moments(facts, VALUE, by), *keys), *keys)


def _named_moments(parts: DataFrame, *keys: str) -> DataFrame:
    return merge_moments(parts, W, keys).select(
        *keys, F.col("n").alias("readings"), F.col("mean").alias("mean_value"), "variance", "sd", "skewness", "kurtosis"
    )


def mean_interval(base: Dashboard, *keys: str, level: float = 0.95) -> DataFrame:
    """Standard error and t interval of the mean; a single value gives (mean, mean)."""
    stats = moments(base, *keys).where(F.col("readings") > 0)
    t = t_quantile_udf(F.lit(0.5 + level / 2), (F.col("readings") - 1).cast("double"))
    several = F.col("readings") > 1
    error = F.when(several, F.col("sd") / F.sqrt(F.col("readings").cast("double"))).otherwise(0.0)
    return (
        stats.withColumn("standard_error", error)
        .withColumn("half", F.when(several, t * F.col("standard_error")).otherwise(0.0))
        .select(
            *keys,
            "readings",
            "mean_value",
            "standard_error",
            (F.col("mean_value") - F.col("half")).alias("ci_low"),
            (F.col("mean_value") + F.col("half")).alias("ci_high"),
        )
    )


def medians(base: Dashboard, *keys: str) -> DataFrame:
    return percentiles(base, {"median": 0.5}, *keys)


def approximate_medians(base: Dashboard, *keys: str) -> DataFrame:
    """Medians in one pass over the facts, weighted by copies, off by less than 1 / ``RESOLUTION`` of their size."""
    return Bins(base, keys).approximate({"median": 0.5})


def mode(base: Dashboard) -> DataFrame:
    """Most frequent value at one decimal place; ties go to the smallest."""
    counts = base.with_facts(mode_value=one_place(VALUE)).counts("mode_value")
    return counts.orderBy(F.desc("n"), F.asc("mode_value")).limit(1)


def _same(*names: str) -> Mapping[str, str]:
    return {n: n for n in names}


def summary(base: Dashboard) -> DataFrame:
    """All headline figures in one row, from one pass over the facts and one over those around the median.

    The bins are the values at one decimal place, which the mode counts anyway.
    """
    parts = _binned_parts(base, one_place, "status")
    bins = Bins(base, number=one_place, parts=parts)
    most = bins.cells.orderBy(F.desc("n"), F.asc(BIN)).limit(1).select(F.col(BIN).alias("mode_value"))
    return side_by_side(
        [
            (_validated(merge_totals(parts, "status")), _same("readings", "validated_percent")),
            (_distinct_labels(base, parts.select("company_id").distinct()), _same("companies", "industries")),
            (_named_moments(parts.where("c > 0")), _same("mean_value", "variance", "sd", "skewness", "kurtosis")),
            (bins.percentiles({"median": 0.5}), _same("median")),
            (most, _same("mode_value")),
        ]
    )


def _binned_parts(base: Dashboard, number: Callable[[Column], Column], *keys: str) -> DataFrame:
    """Parts by company, key and bin, on reliable storage; values that are NULL have no bin."""
    value = F.col(VALUE)
    return checkpointed(base.with_facts(**{BIN: F.when(value.isNotNull(), number(value))}).parts(*keys, BIN))


def sector_pillar_summary(base: Dashboard) -> DataFrame:
    """Count, mean, median, spread, validated share and impact classes per sector and pillar.

    One pass over the facts gives the parts of all figures, a second one reads those around the medians.
    """
    keys = ["industry", "pillar"]
    impact = F.col("impact")
    parts = _binned_parts(base.with_facts(impact=impact_class(VALUE)), log_bin, *keys, "status", "impact")
    first = merge_totals(parts, *keys, "status", "impact").groupBy(*keys).agg(
        _percent(F.col("status") == "VALIDATED").alias("validated_percent"),
        _count(impact == LOW_IMPACT).alias("low_impact"),
        _count(impact == MODERATE_IMPACT).alias("moderate_impact"),
        _count(impact == CRITICAL_IMPACT).alias("critical_impact"),
    )
    spread = _named_moments(parts.where("c > 0"), *keys).select(*keys, "readings", "mean_value", "sd")
    median = Bins(base, keys, parts=parts).percentiles({"median": 0.5})
    return spread.join(first, keys).join(median, keys)


def histogram(base: Dashboard, bins: int = 30, by: str = "pillar") -> DataFrame:
    """Equal-width bins between the smallest and the largest value, counted per ``by``."""
    spans = base.facts.groupBy("company_id").agg(F.min(VALUE).alias("a"), F.max(VALUE).alias("b"))
    known = spans.join(base.labels.select("company_id").distinct(), "company_id", "left_semi")
    span = known.agg(F.struct(F.min("a").alias("lo"), F.max("b").alias("hi")).alias("s")).scalar()
    ratio = F.try_divide(F.col(VALUE) - F.col("_span.lo"), F.col("_span.hi") - F.col("_span.lo"))
    number = F.least(F.coalesce(F.floor(ratio * bins), F.lit(0)) + 1, F.lit(bins)).cast("int")
    binned = base.where_facts(F.col(VALUE).isNotNull()).with_facts(_span=span).with_facts(bin=number)
    return count_by(binned, by, "bin")


def box_summary(base: Dashboard, *keys: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and the number of values beyond, per group."""
    return Bins(base, keys).boxes()


def box_outliers(base: Dashboard, key: str = "pillar", domain: Sequence[str] = PILLARS) -> DataFrame:
    """Rows beyond the whiskers of their group, for a key with a closed domain.

    The fences have one row per domain value, so they are broadcast and the facts stay in place.
    """
    rows = base.rows
    fences = Bins(base, [key]).fences().where(F.col(key).isin(list(domain))).select(key, "fence_low", "fence_high")
    out = ~F.col(VALUE).between(F.col("fence_low"), F.col("fence_high"))
    return rows.join(sized_broadcast(fences, len(domain)), key).where(out).drop("fence_low", "fence_high")


def top_sector_boxes(base: Dashboard, k: int = 15) -> DataFrame:
    return box_summary(base.keep_top(k), "industry", "pillar")


def top_sector_status(base: Dashboard, k: int = 10) -> DataFrame:
    counts = keep_most_frequent(base.totals("industry", "status"), k)
    return counts.select("industry", "status", F.col("n").alias("readings"))


def eligible_sectors(base: Dashboard, least: int = 5) -> DataFrame:
    """Sectors with enough rows for a comparison, largest first."""
    return (
        count_by(base, "industry").where(F.col("readings") >= least).orderBy(F.desc("readings"), F.asc("industry"))
    )


def pivot_means(base: Dashboard, keys: Sequence[str], column: str, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean of each value of ``column`` side by side; the values are given, so no pass looks for them."""
    return _pivoted(base.totals(*keys, column), keys, column, values, names)


def _pivoted(
    totals: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], names: Sequence[str]
) -> DataFrame:
    return totals.groupBy(*keys).agg(*[_mean(F.col(column) == v).alias(n) for v, n in zip(values, names)])


def sector_metric_heat(base: Dashboard, k: int = 15) -> DataFrame:
    """Top sectors by metric means; a missing combination is 0."""
    names = [m.lower().replace(" ", "_") for m in METRIC_NAMES]
    cells = keep_most_frequent(base.totals("industry", "metric_name"), k)
    return _pivoted(cells, ["industry"], "metric_name", METRIC_NAMES, names).fillna(0.0, names)


def pillar_means(base: Dashboard, *keys: str) -> DataFrame:
    """Means of the three pillars per key, complete rows only."""
    names = [p.lower() for p in PILLARS]
    return pivot_means(base, keys, "pillar", PILLARS, names).dropna(subset=names)


def pillar_correlations(base: Dashboard, least: int = 3) -> DataFrame:
    """Pearson coefficient of each pair of pillars over companies; no rows below ``least`` companies."""
    wide = pillar_means(base, "trade_name")
    pairs = [(a, b) for i, a in enumerate(PILLARS) for b in PILLARS[i + 1 :]]
    one = wide.agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(a.lower(), b.lower()).alias(f"{a}_{b}") for a, b in pairs]
    )
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])
    return (
        one.where(F.col("n") >= least)
        .select(F.explode(rows).alias("p"))
        .select(F.col("p.a").alias("pillar_a"), F.col("p.b").alias("pillar_b"), F.round("p.r", 3).alias("r"))
    )


def correlation_matrix(base: Dashboard, least: int = 3) -> DataFrame:
    """The full symmetric matrix, one row per pillar."""
    wide = pillar_means(base, "trade_name")
    names = [p.lower() for p in PILLARS]
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}_{b}") for a in names for b in names])
    rows = F.array(
        *[F.struct(F.lit(p).alias("pillar"), *[F.round(f"{p.lower()}_{b}", 3).alias(b) for b in names]) for p in PILLARS]
    )
    return one.where(F.col("n") >= least).select(F.explode(rows).alias("p")).select("p.*")


def log_summary(log: DataFrame) -> DataFrame:
    """Transitions and distinct readings of the status log."""
    changed = log.select("reading_id").where(F.col("reading_id").isNotNull()).distinct()
    return log.sparkSession.range(1).select(
        log.agg(F.count(F.lit(1))).scalar().alias("transitions"),
        changed.agg(F.count(F.lit(1))).scalar().alias("readings"),
    )


def log_by_new_status(log: DataFrame) -> DataFrame:
    """Transitions into each status and their share of all transitions."""
    counts = log.where(F.col("new_status").isNotNull()).groupBy("new_status").agg(F.count(F.lit(1)).alias("transitions"))
    total = counts.agg(F.sum("transitions"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("transitions") / total.scalar())


def scatter_sample(overview: DataFrame, limit: int = 500) -> DataFrame:
    return overview.select("reading_id", "read_at", VALUE, "pillar").orderBy("reading_id").limit(limit)
