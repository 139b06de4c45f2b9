"""The wide score file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null
from ..schema import FILE_ORDER, SCORE_FILE


def breaks_inside_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field goes on in the next line: some line then has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_scores(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read the CSV by header name; a missing path gives an empty frame.

    Quotes inside a quoted field are doubled, as spreadsheets and pandas write them. Files are split over
    tasks unless a look at their lines shows line breaks inside quoted fields (``multi_line``); a file is then read by one
    task.

    ``row_no`` is always a position that sorts in file order. A file may bring a ``row_no`` column of numbers, which
    then is the ``line``.
    """
    try:
        if multi_line is None:
            multi_line = breaks_inside_quotes(spark, path)
        raw = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCORE_FILE)
    missing = [n for n in SCORE_FILE.names if n != FILE_ORDER and n not in raw.columns]
    if missing:
        raise ValueError(f"the header of {path} lacks {', '.join(missing)}")
    return with_score_types(raw)


def with_score_types(raw: DataFrame) -> DataFrame:
    if FILE_ORDER in raw.columns:
        order = F.struct(
            F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"), F.col(FILE_ORDER).cast("bigint").alias("line")
        )
    else:
        order = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        )
    columns = []
    for f in SCORE_FILE.fields:
        if f.name == FILE_ORDER:
            columns.append(order.alias(FILE_ORDER))
        elif isinstance(f.dataType, T.DoubleType):
            columns.append(nan_to_null(F.col(f.name).try_cast("double")).alias(f.name))
        else:
            columns.append(F.col(f.name).alias(f.name))
    return raw.select(*columns)
