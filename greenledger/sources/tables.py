"""Base tables as Parquet folders, written by plain Spark.

Readings lie in one folder per month, so an append or a rewrite of some months leaves the others alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TABLES

MONTH = "month"


def _write(rows: DataFrame, name: str, path: str, mode: str) -> None:
    table = TABLES[name]
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    if name != "reading":
        rows.write.mode(mode).parquet(path)
        return
    # Ranges of time and key: a task meets few months, and a month with very many rows spans several tasks.
    order = ["read_at", *table.primary_key]
    month = F.coalesce(F.date_format("read_at", "yyyy-MM"), F.lit("none"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(MONTH, month)
    ranged.write.mode(mode).partitionBy(MONTH).parquet(path)


def append_rows(rows: DataFrame, name: str, path: str) -> None:
    """Add rows to a table; what is there is not touched."""
    _write(rows, name, path, "append")


def replace_rows(rows: DataFrame, name: str, path: str) -> None:
    """The whole table anew. ``rows`` must not be read from ``path``."""
    _write(rows, name, path, "overwrite")


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table with its declared schema; a missing path gives an empty frame."""
    schema = TABLES[name].schema
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)  # without the column of the folders
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
