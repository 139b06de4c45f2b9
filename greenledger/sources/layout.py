"""Readings laid out so that a question about some companies, some days or both reads few files.

Rows are sorted along a curve that interleaves the bits of a company's place (its id's hash) and of the time: each file
then covers a short span of both, so the smallest and largest values in its footer rule it out for most questions. A
Bloom filter on the company in every file rules out the others. The curve's position is stored as ``cell``, and
``cells_of`` turns a company or a span of days into a condition on it that Spark pushes into the scan.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import TABLES

CELL = "cell"
#: Bits of the company's hash and of the time in a cell.
BITS = 10
#: Days a unit of time in a cell covers, and the day of unit 0; earlier and later days fall into the first and last unit.
UNIT_DAYS, FIRST_DAY = 32, date(1970, 1, 1)


def _company_place(company: Column) -> Column:
    return F.pmod(F.xxhash64(company), F.lit(1 << BITS)).cast("int")


def _time_place(day: Column) -> Column:
    unit = F.floor(F.datediff(day, F.lit(FIRST_DAY)) / UNIT_DAYS)
    return F.coalesce(F.greatest(F.least(unit, F.lit((1 << BITS) - 1)), F.lit(0)), F.lit(0)).cast("int")


def interleaved(a: Column, b: Column) -> Column:
    """The bits of two numbers below ``2 ** BITS`` in turn, those of ``a`` in the odd places."""
    out = F.lit(0)
    for i in range(BITS):
        for number, place in ((a, 2 * i + 1), (b, 2 * i)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(number, i).bitwiseAND(F.lit(1)), place))
    return out


def write_clustered(readings: DataFrame, path: str, files: int, mode: str = "overwrite") -> None:
    """Readings as ``files`` Parquet files along the curve; a company of a third of all rows spans as many as it needs."""
    fields = TABLES["reading"].schema.fields
    rows = readings.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    day = F.col("read_at").cast("date")
    placed = rows.withColumn(CELL, interleaved(_company_place(F.col("company_id")), _time_place(day)))
    order = [CELL, "company_id", "read_at", "reading_id"]
    (
        placed.repartitionByRange(files, *order).sortWithinPartitions(*order)
        .write.mode(mode).option("parquet.bloom.filter.enabled#company_id", "true")
        .option("parquet.bloom.filter.expected.ndv#company_id", "100000").parquet(path)
    )


def spans_of(company: int | None = None, first: int = 0, last: int = (1 << BITS) - 1, most: int = 64) -> list[tuple[int, int]]:
    """Spans of cells that hold a company's place and the units of time from ``first`` to ``last``.

    The square of places and units is halved again and again; a part inside the question is one span, one outside is none.
    More than ``most`` spans are merged over the smallest gaps, which adds cells but drops none.
    """
    found: list[tuple[int, int]] = []

    def visit(bit: int, a: int, b: int, start: int) -> None:
        size = 1 << bit
        if (company is not None and not a <= company < a + size) or b > last or b + size <= first:
            return
        inside = (company is None or size == 1) and first <= b and b + size - 1 <= last
        if inside:
            found.append((start, start + size * size - 1))
            return
        half, quarter = size >> 1, (size * size) >> 2
        for i, (x, y) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            visit(bit - 1, a + x * half, b + y * half, start + i * quarter)

    visit(BITS, 0, 0, 0)
    merged: list[tuple[int, int]] = []
    for lo, hi in found:
        if merged and lo == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], hi)
        else:
            merged.append((lo, hi))
    while len(merged) > most:
        i = min(range(len(merged) - 1), key=lambda k: merged[k + 1][0] - merged[k][1])
        merged[i : i + 2] = [(merged[i][0], merged[i + 1][1])]
    return merged


def read_clustered(
    spark: SparkSession, path: str, company: int | None = None, first_day: date | None = None, last_day: date | None = None
) -> DataFrame:
    """Readings of a company and of days (inclusive), either of which may be missing; files outside are not read."""
    rows = spark.read.parquet(path)
    last_unit = (1 << BITS) - 1

    def unit(day: date) -> int:
        return max(0, min((day - FIRST_DAY).days // UNIT_DAYS, last_unit))

    if company is not None or first_day is not None or last_day is not None:
        place = None
        if company is not None:
            place = spark.range(1).select(_company_place(F.lit(company).cast("bigint"))).first()[0]
        spans = spans_of(place, unit(first_day) if first_day else 0, unit(last_day) if last_day else last_unit)
        held = F.lit(False)
        for lo, hi in spans:
            held = held | F.col(CELL).between(lo, hi)
        rows = rows.where(held)
    if company is not None:
        rows = rows.where(F.col("company_id") == company)
    if first_day is not None:
        rows = rows.where(F.col("read_at") >= F.lit(first_day.isoformat()).cast("timestamp_ntz"))
    if last_day is not None:
        rows = rows.where(F.col("read_at") < F.lit((last_day + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return rows.select(*TABLES["reading"].schema.names)
