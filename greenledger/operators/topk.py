"""Top-k reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from ..session import checkpointed


def newest_joined(
    rows: DataFrame,
    order: Sequence[Column],
    k: int,
    join_dimensions: Callable[[DataFrame], DataFrame],
    slack: int = 4,
) -> DataFrame:
    """First k rows, in ``order``, of ``join_dimensions(rows)`` without joining all rows.

    The first ``slack * k`` rows are joined on their own. When k of them survive the joins they are the
    answer, since every other row comes later in the order; when fewer survive, all rows are joined.
    ``order`` must be total on ``rows``.
    """
    head = checkpointed(rows.orderBy(*order).limit(slack * k))
    joined = checkpointed(join_dimensions(head).orderBy(*order).limit(k))
    if joined.count() == k:
        return joined.orderBy(*order)
    return join_dimensions(rows).orderBy(*order).limit(k)
