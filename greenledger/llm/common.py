"""What several operators of this package share: tables, words, column names, materialised steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, scratch_path

#: A word is a run without these characters; the same class in Java, RE2 and Python syntax.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """All words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def materialised(df: DataFrame) -> DataFrame:
    """Narrow results that later steps read more than once, on the shared checkpoint folder."""
    return checkpointed(df)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own on the shared folder, for the other side of a join with a hot key.

    Where an aggregate stands between its exchange and a join, Spark cannot split the join's hot keys; a table is read
    without any partitioning, so that both sides are dealt out for the join alone, or the smaller one is broadcast once its
    size is known.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
