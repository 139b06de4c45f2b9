"""The clustered layout: right rows, and few row groups left by the footers."""

import glob
import random
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest

from greenledger.schema import TABLES
from greenledger.session import scratch_path
from greenledger.sources import layout


@pytest.fixture(scope="module")
def stored(spark):
    dice = random.Random(2)
    start = datetime(2020, 1, 1)
    rows = [
        (i, start + timedelta(hours=dice.randrange(365 * 24)), float(i), "PENDING", 1,
         7 if i % 3 == 0 else dice.randrange(400), 1)
        for i in range(12_000)
    ] + [(20_000, None, 1.0, "PENDING", 1, 7, 1), (20_001, start, 1.0, "PENDING", 1, None, 1)]
    df = spark.createDataFrame(rows, TABLES["reading"].schema)
    path = scratch_path(spark, "clustered")
    layout.write_clustered(df, path, files=32)
    return path, rows


def test_spans_hold_exactly_the_cells():
    """Against each cell, for questions of every kind."""
    side = 1 << layout.BITS

    def cell(a, b):
        return sum(((a >> i & 1) << (2 * i + 1)) | ((b >> i & 1) << (2 * i)) for i in range(layout.BITS))

    dice = random.Random(4)
    for company in (None, 0, 513, side - 1):
        for first, last in ((0, side - 1), (100, 140), (77, 77)):
            spans = layout.spans_of(company, first, last, most=10**6)
            assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
            few = layout.spans_of(company, first, last, most=5)
            assert len(few) <= 5
            for _ in range(300):
                a = dice.randrange(side) if company is None or dice.random() < 0.3 else company
                b = dice.choice([first, last, dice.randrange(side), min(last + 1, side - 1), max(first - 1, 0)])
                wanted = (company is None or a == company) and first <= b <= last
                assert any(lo <= cell(a, b) <= hi for lo, hi in spans) == wanted
                assert not wanted or any(lo <= cell(a, b) <= hi for lo, hi in few)


@pytest.mark.parametrize("company", [None, 7, 13, 999])
@pytest.mark.parametrize("days", [(None, None), (date(2020, 3, 1), date(2020, 3, 31)), (None, date(2020, 1, 5)), (date(2021, 1, 1), None)])
def test_rows_of_a_question(spark, stored, company, days):
    path, rows = stored
    got = layout.read_clustered(spark, path, company, *days)
    want = {
        r[0] for r in rows
        if (company is None or r[5] == company)
        and (days[0] is None or (r[1] is not None and r[1].date() >= days[0]))
        and (days[1] is None or (r[1] is not None and r[1].date() <= days[1]))
    }
    assert {r.reading_id for r in got.collect()} == want and got.schema.names == TABLES["reading"].schema.names


def test_footers_rule_out_most_row_groups(spark, stored, capsys):
    path, _ = stored
    question = layout.read_clustered(spark, path, 13, date(2020, 3, 1), date(2020, 3, 31))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        question.explain("formatted")
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(cell," in pushed and "EqualTo(company_id,13)" in pushed and "LessThan(read_at," in pushed
    place = spark.range(1).select(layout._company_place(layout.F.lit(13).cast("bigint"))).first()[0]
    units = [(d - layout.FIRST_DAY).days // layout.UNIT_DAYS for d in (date(2020, 3, 1), date(2020, 3, 31))]
    spans = layout.spans_of(place, *units)
    groups = []
    for name in glob.glob(f"{path}/*.parquet"):
        footer = pq.ParquetFile(name).metadata
        for g in range(footer.num_row_groups):
            columns = {footer.row_group(g).column(c).path_in_schema: footer.row_group(g).column(c) for c in range(footer.num_columns)}
            s = columns[layout.CELL].statistics
            groups.append(any(s.min <= hi and lo <= s.max for lo, hi in spans))
    assert len(groups) >= 30 and sum(groups) <= 4
