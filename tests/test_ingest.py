import os

import pytest
from pyspark.sql import functions as F

from greenledger.operators import ingest
from greenledger.operators.topk import newest_joined
from greenledger.schema import SCORE_FILE
from greenledger.sources.scores import read_scores

HEADER = ("industry,ticker,name,exchange,last_processing_date,environment_score,social_score,governance_score,"
          "total_score,environment_grade,social_grade,governance_grade,total_grade,extra\n")


def line(ticker, name, day="9-4-2022", score="500", grade="A"):
    return f"Tech,{ticker},{name},NYSE,{day},{score},NaN,30,1.5,{grade}, bb ,,CCC,x\n"


@pytest.fixture
def score_file(tmp_path):
    for part, tickers in enumerate((("b", "a", "b"), ("c", "a"))):
        with open(tmp_path / f"part-{part}.csv", "w") as f:
            f.write(HEADER + "".join(line(t, f"{t}{part}{i}") for i, t in enumerate(tickers)))
    return str(tmp_path)


def test_missing_file_is_an_empty_frame(spark):
    df = read_scores(spark, "/no/such/file.csv")
    assert df.schema == SCORE_FILE and df.count() == 0


def test_file_order_and_first_row(spark, score_file):
    raw = read_scores(spark, score_file)
    assert raw.count() == 5 and raw.where("social_score is null").count() == 5
    listed = ingest.listed_companies(raw).orderBy("company_id").collect()
    assert [(r.company_id, r.ticker, r.name) for r in listed] == [(1, "b", "b00"), (2, "a", "a01"), (3, "c", "c10")]
    assert {str(r.day) for r in listed} == {"2022-04-09"}


def test_long_file_keeps_its_order(spark, tmp_path):
    path = os.path.join(tmp_path, "long.csv")
    with open(path, "w") as f:
        f.write(HEADER + "".join(line(f"t{i * 7919 % 6000}", f"n{i}", day="31-02-2022") for i in range(12000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        listed = ingest.listed_companies(read_scores(spark, path)).toPandas().sort_values("company_id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert listed["name"].tolist() == [f"n{i}" for i in range(6000)]
    assert set(listed["day"].astype(str)) == {"2022-04-19"}


def test_model_tables(spark, score_file):
    auditors = spark.createDataFrame([("x",), ("y",)], "auditor_id string")
    t = ingest.model_tables(read_scores(spark, score_file), auditors)
    readings = t["reading"].orderBy("reading_id").collect()
    assert [(r.reading_id, r.company_id, r.metric_id) for r in readings] == [
        (m * 3 + c, c, m + 1) for m in range(4) for c in (1, 2, 3)]
    assert [r.status for r in readings[::3]] == ["VALIDATED", "PENDING", "REJECTED", "REJECTED"]
    audit = t["audit"].collect()
    assert len(audit) == 1 and str(audit[0].audit_date) == "2022-05-09" and audit[0].auditor_id in ("x", "y")
    assert sorted(tuple(r) for r in t["audit_reading"].collect()) == [(1, 1), (1, 4)]
    assert t["company"].where("tax_id rlike '^[0-9]{2}[.][0-9]{3}[.][0-9]{3}/[0-9]{4}-[0-9]{2}$'").count() == 3


def test_hash_pick_is_even_and_stable(spark):
    people = spark.createDataFrame([(f"p{i}",) for i in range(4)], "who string")
    ids = spark.range(4000)
    once = ingest.hash_pick(ids, "id", people, "who").toPandas()
    again = ingest.hash_pick(ids.repartition(13), "id", people, "who").toPandas()
    assert once.set_index("id")["who"].sort_index().equals(again.set_index("id")["who"].sort_index())
    assert once["who"].value_counts().between(900, 1100).all()


@pytest.mark.parametrize("keep", ["id % 2 = 0", "id < 3", "id < 0"])
def test_top_rows_survive_dropping_joins(spark, keep):
    rows = spark.range(100).withColumn("v", F.col("id") % 10)
    dims = spark.range(100).where(keep)
    order = [F.desc("v"), F.asc("id")]
    got = newest_joined(rows, order, 5, lambda r: r.join(dims, "id")).collect()
    assert got == rows.join(dims, "id").orderBy(*order).limit(5).collect()
