"""Weighted central moments in one pass over the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import exact_parts, weighed_parts, whole_sum


def weighted_moments(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sum of squares about the mean (ss), sample variance and sd, biased skewness, excess kurtosis.

    Rows of equal weight are aggregated with the built-in, merge-safe moments; the few partial results of a
    group are then shifted to the group's mean. The rows are read once.
    """
    return merge_moments(partial_moments(df, value, [*keys, weight]), weight, keys)


def partial_moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Count, exact sum and shape of the values of each group that are neither NULL nor NaN; NULL keys form no group."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), *sum_and_shape(value))


def sum_and_shape(value: str) -> list[Column]:
    """Aggregates of a part besides its count of values: both parts of the sum, variance and shape."""
    near, rest = exact_parts(value)
    return [
        near.alias("s"),
        rest.alias("e"),
        F.var_pop(value).alias("v2"),
        F.coalesce(F.skewness(value), F.lit(0.0)).alias("g1"),
        F.coalesce(F.kurtosis(value), F.lit(-3.0)).alias("g2"),
    ]


def merge_moments(parts: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Moments of groups from ``partial_moments``, each part counted ``weight`` times.

    The parts of a group are shifted to its mean, which comes from their sums first.
    """
    for k in keys:
        parts = parts.where(F.col(k).isNotNull())
    near, rest = weighed_parts(F.col("s"), F.col("e"), weight)
    d, v2 = F.col("d"), F.col("v2")
    p2, p3, p4 = (lambda c: c * c), (lambda c: c * c * c), (lambda c: c * c * c * c)
    m3, m4 = F.col("g1") * F.sqrt(v2) * v2, (F.col("g2") + 3) * v2 * v2
    weighed = parts.withColumn("n", F.col("c") * F.col(weight))
    mean = F.try_divide(whole_sum(F.sum(near), F.sum(rest)), F.sum("n").cast("double"))
    if keys:
        centred = weighed.join(weighed.groupBy(*keys).agg(mean.alias("m")), list(keys))
    else:
        centred = weighed.withColumn("m", weighed.agg(mean).scalar())
    sums = (
        centred.withColumn("d", whole_sum(F.col("s"), F.col("e")) / F.col("c").cast("double") - F.col("m"))
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
            F.max("m").alias("mean"),
            F.sum(F.col("n") * (v2 + p2(d))).alias("ss"),
            F.sum(F.col("n") * (m3 + 3 * d * v2 + p3(d))).alias("s3"),
            F.sum(F.col("n") * (m4 + 4 * d * m3 + 6 * p2(d) * v2 + p4(d))).alias("s4"),
        )
    )
    n = F.col("n").cast("double")
    m2 = F.try_divide(F.col("ss"), n)
    variance = F.try_divide(F.col("ss"), n - 1)
    return sums.select(
        *keys,
        "n",
        "mean",
        "ss",
        variance.alias("variance"),
        F.sqrt(variance).alias("sd"),
        F.try_divide(F.try_divide(F.col("s3"), n), F.sqrt(m2) * m2).alias("skewness"),
        (F.try_divide(F.try_divide(F.col("s4"), n), m2 * m2) - 3).alias("kurtosis"),
    )
