"""Readings validated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import split_by_rules
from ..schema import TABLES


def validate_arrivals(arrivals: DataFrame, accepted: str, rejected: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Split a stream of readings into accepted rows and rejected rows with their reasons.

    A batch is written to a folder of its own number in overwrite mode, so a batch that is run again after a
    failure replaces itself instead of adding rows twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_by_rules(batch, TABLES["reading"])
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
