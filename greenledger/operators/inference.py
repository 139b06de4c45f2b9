"""Comparison of two sectors: Levene, Welch and Mann-Whitney, each as one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import exact_mean
from ..functions.numerics import f_upper_udf, rank_test_p_udf, t_two_sided_udf
from ..session import checkpointed
from .dashboard import VALUE, W, Dashboard
from .moments import merge_moments, partial_moments, weighted_moments
from .ordering import exact_percentiles, running_total
from .rows import side_by_side
from .selection import percentiles

ALPHA = 0.05
LEAST = 3


def _side(a: str) -> Column:
    return F.when(F.col("industry") == a, "a").otherwise("b").alias("side")


def two_groups(base: Dashboard, a: str, b: str) -> DataFrame:
    """Distinct values of two sectors, marked ``a`` and ``b``, weighted by how often they occur; the tests read them, so
    they are materialised."""
    counts = base.filter(industries=[a, b]).where_facts(F.col(VALUE).isNotNull()).counts("industry", VALUE)
    return checkpointed(counts.select(_side(a), VALUE, F.col("n").alias(W)))


def sector_levene(base: Dashboard, a: str, b: str) -> DataFrame:
    """``levene`` of two sectors without a look at single values: the medians come from bins, and the distances to both
    medians are combined per company before the labels say which of the two counts."""
    both = base.filter(industries=[a, b]).where_facts(F.col(VALUE).isNotNull())
    centres = {r["industry"]: r["centre"] for r in percentiles(both, {"centre": 0.5}, "industry").collect()}  # two rows
    distances = [
        F.struct(F.lit(name).alias("_of"), F.abs(F.col(VALUE) - F.lit(centres.get(name)).cast("double")).alias("z"))
        for name in (a, b)
    ]
    parts = partial_moments(both.facts.select("company_id", F.inline(F.array(*distances))), "z", ["company_id", "_of"])
    labels = both._labels_by("industry")
    same = (parts["company_id"] == labels["company_id"]) & (F.col("_of") == F.col("industry"))
    moments = merge_moments(parts.join(labels, same).withColumn("side", _side(a)), W, ["side"])
    return _levene(_sides(moments))


def group_means(pair: DataFrame) -> DataFrame:
    return pair.groupBy("side").agg(F.sum(W).cast("bigint").alias("n"), exact_mean(VALUE, W).alias("mean_value"))


def _spread(pair: DataFrame, value: str) -> DataFrame:
    """n, mean and sum of squares of both sides in one row."""

    return _sides(weighted_moments(pair, value, W, ["side"]))


def _sides(moments: DataFrame) -> DataFrame:
    def side(s: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c))).cast("double").alias(f"{c}_{s}")

    return moments.agg(*[side(s, c) for s in "ab" for c in ("n", "mean", "ss")])


def _enough(row: DataFrame) -> DataFrame:
    """No result below three values on either side."""
    return row.where((F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST))


def welch(pair: DataFrame) -> DataFrame:
    """t statistic with unequal variances, Welch-Satterthwaite degrees of freedom, two-sided p, decision."""
    va = F.col("ss_a") / (F.col("n_a") - 1) / F.col("n_a")
    vb = F.col("ss_b") / (F.col("n_b") - 1) / F.col("n_b")
    return (
        _enough(_spread(pair, VALUE))
        .withColumn("va", va)
        .withColumn("vb", vb)
        .withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(F.col("va") + F.col("vb"))))
        .withColumn(
            "df",
            F.try_divide(
                F.pow(F.col("va") + F.col("vb"), F.lit(2)),
                F.pow("va", F.lit(2)) / (F.col("n_a") - 1) + F.pow("vb", F.lit(2)) / (F.col("n_b") - 1),
            ),
        )
        .withColumn("p", t_two_sided_udf("t", "df"))
        .withColumn("decision", decision("p"))
        .select("t", "df", "p", "decision")
    )


def decision(p: str, alpha: float = ALPHA) -> Column:
    return F.when(F.col(p) < alpha, "reject").when(F.col(p).isNotNull(), "keep")


def levene(pair: DataFrame) -> DataFrame:
    """Median-centred Levene statistic W and its p, from weighted values."""
    centres = exact_percentiles(pair, VALUE, {"centre": 0.5}, ["side"], W).where(F.col("side").isin("a", "b"))
    z = pair.join(F.broadcast(centres), "side").withColumn("z", F.abs(F.col(VALUE) - F.col("centre")))
    return _levene(_spread(z, "z"))


def _levene(spread: DataFrame) -> DataFrame:
    n, k = F.col("n_a") + F.col("n_b"), 2
    grand = (F.col("n_a") * F.col("mean_a") + F.col("n_b") * F.col("mean_b")) / n
    between = F.col("n_a") * (F.col("mean_a") - grand) * (F.col("mean_a") - grand) + F.col("n_b") * (F.col("mean_b") - grand) * (F.col("mean_b") - grand)
    return (
        _enough(spread)
        .withColumn("w", F.try_divide((n - k) * between, (k - 1) * (F.col("ss_a") + F.col("ss_b"))))
        .withColumn("p", f_upper_udf("w", F.lit(float(k - 1)), n - k))
        .select("w", "p")
    )


def mann_whitney(pair: DataFrame) -> DataFrame:
    """U of the first group, U of the second, tie term and two-sided p.

    Values are counted per distinct value first, so the test needs one running total over the distinct
    values instead of ranks over all rows.
    """
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col(W)).otherwise(0)).cast("bigint")
    counts = pair.groupBy(VALUE).agg(on("a").alias("a"), on("b").alias("b"))
    below = running_total(counts, [VALUE], F.col("b"), name="b_below")
    t = (F.col("a") + F.col("b")).cast("decimal(38,0)")
    ties = F.sum(t.cast("double") * t.cast("double") * t.cast("double") - t.cast("double"))
    half = F.col("a").cast("decimal(18,0)") * (2 * F.col("b_below") + F.col("b")).cast("decimal(19,0)")
    return (
        below.agg(
            F.sum("a").cast("double").alias("n_a"),
            F.sum("b").cast("double").alias("n_b"),
            (F.sum(half).cast("double") / 2).alias("u_a"),
            ties.alias("tie_term"),
        )
        .transform(_enough)
        .withColumn("u_b", F.col("n_a") * F.col("n_b") - F.col("u_a"))
        .withColumn("p", rank_test_p_udf("u_a", "n_a", "n_b", "tie_term"))
        .select("n_a", "n_b", "u_a", "u_b", "tie_term", "p")
    )


def compare_sectors(base: Dashboard, a: str, b: str) -> DataFrame:
    """The three tests and the group means in one row."""
    if a == b:
        raise ValueError("choose two different sectors")
    pair = two_groups(base, a, b)
    means = group_means(pair)
    side = lambda s: means.where(F.col("side") == s)
    return side_by_side(
        [
            (side("a"), {"n": "n_a", "mean_value": "mean_a"}),
            (side("b"), {"n": "n_b", "mean_value": "mean_b"}),
            (sector_levene(base, a, b), {"w": "levene_w", "p": "levene_p"}),
            (welch(pair), {"t": "welch_t", "df": "welch_df", "p": "welch_p", "decision": "decision"}),
            (mann_whitney(pair), {"u_a": "u", "p": "u_p"}),
        ]
    ).select(F.lit(a).alias("sector_a"), F.lit(b).alias("sector_b"), "*")
