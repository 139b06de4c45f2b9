"""Small results: one-row frames side by side, and broadcasts behind a size check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def side_by_side(parts: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Columns of several one-row frames in one row, as scalar subqueries (no join).

    Each part is a frame and the mapping from its columns to output names.
    """
    spark = parts[0][0].sparkSession
    held = spark.range(1).select(
        *[df.select(F.struct(*columns)).scalar().alias(f"_{i}") for i, (df, columns) in enumerate(parts)]
    )
    return held.select(*[F.col(f"_{i}.{c}").alias(n) for i, (_, columns) in enumerate(parts) for c, n in columns.items()])


def sized_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Materialise a result and broadcast it when it has at most ``max_rows`` rows, else leave it to a shuffle join."""
    return counted_broadcast(checkpointed(df), max_rows)


def counted_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """The same for a frame that is cheap to make again, such as a filter over materialised rows."""
    return F.broadcast(df) if df.count() <= max_rows else df
