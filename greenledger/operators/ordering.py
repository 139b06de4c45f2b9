"""Positions in a total order without ever sorting one whole group in one task.

Rows are range-partitioned along the order, so a bucket (the partition number) holds about its share of the rows
whatever the distribution, and a large group spans many buckets. The numbered rows are materialised before the
number is used twice; after that a result does not depend on the partitioning or on a task that ran again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from ..session import checkpointed
from .rows import sized_broadcast

#: Rows a range holds, about.
RANGE_ROWS = 2_000_000
_PLACE = (1 << 33) - 1


def ranges_for(df: DataFrame, rows: int | None = None) -> int:
    """How many ranges to sort in: by the number of rows, and no fewer than the session's shuffle partitions."""
    rows = df.count() if rows is None else rows
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a ``_bucket`` that never falls along ``order``, on reliable storage."""
    # A fixed number, since AQE would merge partitions and with them the buckets.
    buckets = ranges_for(df)
    return checkpointed(df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id()))


def _cells(marked: DataFrame, groups: Sequence[str], weight: str, *more: Column) -> DataFrame:
    """Weight of each (group, bucket) and the weight before it: at most one row per bucket and group."""
    ordered = Window.partitionBy(*groups).orderBy("_bucket")
    return (
        marked.groupBy(*groups, "_bucket")
        .agg(F.sum(weight).alias("_cell"), *more)
        .withColumn("_prior", F.sum("_cell").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell"))
        .withColumn("_total", F.sum("_cell").over(Window.partitionBy(*groups)))
    )


def _prefix_sums(weights: Iterator[pd.Series]) -> Iterator[pd.Series]:
    carried = 0
    for batch in weights:
        sums = batch.cumsum() + carried
        carried = int(sums.iloc[-1]) if len(sums) else carried
        yield sums


#: Sum of the weights of a partition's rows up to and with each row; only the weights pass through Python.
prefix_sum = F.pandas_udf(_prefix_sums, LongType()).asNondeterministic()


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: Column | None = None,
    groups: Sequence[str] = (),
    name: str = "before",
    total: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add the weight of all rows that come earlier in ``order`` within the same group.

    ``order`` must be unique within a group and the group columns must not be NULL. ``total`` also adds the
    weight of the whole group. ``rows`` is their number where the caller knows it.

    One shuffle of the rows: they are sorted in ranges of the order, each row keeps the weight up to it within its
    range, and the few sums of (group, range) say what lies before the range and where in it the group starts.
    """
    weight = F.lit(1) if weight is None else weight
    keys = [*groups, *order]
    placed = df.withColumn("_w", weight.cast("bigint")).repartitionByRange(ranges_for(df, rows), *keys).sortWithinPartitions(*keys)
    marked = checkpointed(
        placed.withColumn("_upto", prefix_sum("_w")).withColumn("_bucket", F.shiftright(F.monotonically_increasing_id(), 33))
    )
    cells = _cells(marked, groups, "_w", F.min(F.col("_upto") - F.col("_w")).alias("_open")).drop("_cell")
    # Without groups there is one row per range; with groups their number decides.
    cells = sized_broadcast(cells) if groups else F.broadcast(cells)
    place = F.col("_prior") + F.col("_upto") - F.col("_w") - F.col("_open")
    out = marked.join(cells, [*groups, "_bucket"]).withColumn(name, place.cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.drop("_w", "_upto", "_open", "_bucket", "_prior", "_total")


def dense_ids(df: DataFrame, order: Sequence[str], name: str, start: int | Column = 1) -> DataFrame:
    """Number the rows 1, 2, 3 ... along ``order``, which must be unique.

    One shuffle: a row's place in its sorted range is part of the id Spark gives it, and what lies before the range
    comes from the sizes of the ranges, one row each.
    """
    first = F.lit(start).cast("bigint") if isinstance(start, int) else start
    placed = df.repartitionByRange(ranges_for(df), *order).sortWithinPartitions(*order)
    marked = checkpointed(placed.withColumn("_i", F.monotonically_increasing_id()))
    bucket = F.shiftright("_i", 33)
    sizes = marked.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select("_bucket", before.alias("_before"))
    place = F.col("_before") + F.col("_i").bitwiseAND(F.lit(_PLACE)) + first
    out = marked.withColumn("_bucket", bucket).join(F.broadcast(starts), "_bucket")
    return out.withColumn(name, place.cast("bigint")).drop("_bucket", "_i", "_before")


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Occurrences of each distinct value, combined before the shuffle, so a hot value is one row."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    kept = df.where(F.col(value).isNotNull())
    for g in groups:
        kept = kept.where(F.col(g).isNotNull())
    return kept.groupBy(*groups, value).agg(n.cast("bigint").alias("n"))


def ranged_counts(df: DataFrame, value: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Value counts in buckets along (groups, value), on reliable storage."""
    return ranged(value_counts(df, value, groups, weight), [*groups, value])


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    groups: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles, one column per entry of ``probs``.

    The built-in exact percentile holds all values of a group in one buffer. Here the distinct values are
    counted, the counts of the buckets tell which few hold the wanted ranks, and only those are sorted.
    """
    return count_percentiles(ranged_counts(df, value, groups, weight), value, probs, groups)


def count_percentiles(counts: DataFrame, value: str, probs: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Percentiles of ``ranged_counts``, for callers that need the counts as well."""
    groups = list(groups)
    cells = _cells(counts, groups, "n")

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    ranks = F.array(*[r for p in probs.values() for r in (F.floor(position(p)), F.ceil(position(p)))])
    wanted = cells.withColumn("_ranks", ranks).where(
        F.exists("_ranks", lambda r: (r >= F.col("_prior")) & (r < F.col("_prior") + F.col("_cell")))
    )
    # A few buckets per group: with a broadcast the counts of all other buckets are dropped where they are.
    wanted = sized_broadcast(wanted.drop("_ranks", "_cell"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(wanted, [*groups, "_bucket"]).withColumn(
        "_after", F.col("_prior") + F.sum("n").over(inside)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_after") - F.col("n") <= rank) & (rank < F.col("_after")), F.col(value)))

    picks = []
    for i, p in enumerate(probs.values()):
        picks += [at(F.floor(position(p))).alias(f"_lo{i}"), at(F.ceil(position(p))).alias(f"_hi{i}")]
    picked = placed.groupBy(*groups).agg(F.max("_total").alias("_total"), *picks)
    return picked.select(
        *groups,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position(p) - F.floor(position(p)))).alias(n)
            for i, (n, p) in enumerate(probs.items())
        ],
    )


def hash_order(df: DataFrame, key: Sequence[str], seed: int, name: str = "draw") -> DataFrame:
    """A seeded shuffle key that depends on the row's own key alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return df.withColumn(name, F.md5(text))


def hold_out(
    df: DataFrame, key: Sequence[str], seed: int, share: float = 0.2, strata: Sequence[str] = ()
) -> DataFrame:
    """Mark ceil(share * n) rows of each stratum as the test set (column ``is_test``)."""
    drawn = hash_order(df, key, seed)
    ranked = running_total(drawn, ["draw", *key], groups=strata, name="_place", total="_n")
    cut = F.ceil(F.col("_n").cast("decimal(20,0)") * F.lit(str(share)).cast("decimal(6,5)"))
    return ranked.withColumn("is_test", F.col("_place") < cut).drop("draw", "_place", "_n")


def hash_split(df: DataFrame, key: Sequence[str], seed: int, share: float = 0.2) -> DataFrame:
    """Mark about ``share`` of the rows as the test set (``is_test``), each by its own key alone: no order, no shuffle.

    A row stays on its side when others come or go; the size of the test set is expected, not exact.
    """
    limit = f"{int(share * 16**12):012x}" if share < 1 else "g"
    return hash_order(df, key, seed).withColumn("is_test", F.col("draw") < limit).drop("draw")


def contiguous_folds(
    df: DataFrame, order: Sequence[str], k: int = 5, strata: Sequence[str] = (), name: str = "fold"
) -> DataFrame:
    """Cut each stratum, in order, into ``k`` runs; the first n % k runs have one row more."""
    ranked = running_total(df, order, groups=strata, name="_place", total="_n")
    short, extra = F.expr(f"_n div {k}"), F.col("_n") % k
    head = (short + 1) * extra
    fold = F.when(F.col("_place") < head, F.expr(f"_place div (_n div {k} + 1)")).otherwise(
        extra + F.try_divide(F.col("_place") - head, short).cast("bigint")
    )
    return ranked.withColumn(name, fold.cast("int")).drop("_place", "_n")
