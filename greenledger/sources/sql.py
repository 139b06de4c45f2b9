"""SQL texts with bound parameters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

Parameters = dict[str, Any] | list[Any] | tuple[Any, ...] | None


def query(spark: SparkSession, text: str, params: Parameters = None) -> DataFrame:
    """Run a statement; ``?`` takes a list, ``:name`` a dict. Values are never put into the text."""
    if not params:
        return spark.sql(text)
    return spark.sql(text, args=params if isinstance(params, dict) else list(params))
