from datetime import datetime

import pytest
from pyspark.sql import functions as F

from greenledger.functions.columns import CRITICAL_IMPACT, LOW_IMPACT, MODERATE_IMPACT, impact_class, status_from_grade
from greenledger.operators import dml, rules
from greenledger.schema import TABLES
from greenledger.session import scratch_path
from greenledger.sources.seed import seed_tables
from greenledger.sources.tables import append_rows, read_table, replace_rows

AT = datetime(2022, 4, 19, 9)


def readings(spark, *rows):
    full = [(i, at, v, s, 1, 1, 1) for i, at, v, s in rows]
    return spark.createDataFrame(full, TABLES["reading"].schema)


@pytest.fixture
def tables(spark):
    company = [(1, "One", "t1", "X", "s", None), (2, "Two", "t2", "X", "s", 1), (3, "Three", "t3", "Y", None, None)]
    return {
        **seed_tables(spark),
        "company": spark.createDataFrame(company, TABLES["company"].schema),
        "site": spark.createDataFrame([(1, 1, "HQ", None)], TABLES["site"].schema),
        "reading": readings(spark, (1, AT, 10.0, "PENDING"), (2, AT, 6000.0, "REJECTED"), (3, AT, 5000.0, "REJECTED")),
    }


def test_guard_fires_on_negative_only(spark):
    rows = readings(spark, (10, AT, -1.0, "PENDING"), (11, AT, 0.0, "PENDING"), (12, AT, None, "PENDING"), (13, AT, 1.0, "ODD"))
    good, bad = rules.split_by_rules(rows, TABLES["reading"])
    assert [r.reading_id for r in good.collect()] == [11]
    assert {r.reading_id: r.reason for r in bad.collect()} == {
        10: "measured_value is negative", 12: "measured_value is null", 13: "status not allowed"}
    assert rules.negative_values(rows).count() == 1


@pytest.mark.parametrize(
    "row,rule",
    [((9, AT, -1.0, "PENDING", 1, 1, 1), "insert guard"), ((9, AT, 1.0, "ODD", 1, 1, 1), "check"),
     ((9, AT, None, "PENDING", 1, 1, 1), "not null"), ((1, AT, 1.0, "PENDING", 1, 1, 1), "primary key"),
     ((9, AT, 1.0, "PENDING", 7, 1, 1), "foreign key"), ((9, AT, 1.0, "PENDING", 1, 1, 77), "foreign key")],
)
def test_one_bad_row_refuses_the_statement(spark, tables, row, rule):
    fine = (8, AT, 1.0, "PENDING", 1, 1, 1)
    batch = spark.createDataFrame([fine, row], TABLES["reading"].schema)
    with pytest.raises(dml.RuleViolation, match=rule):
        dml.insert("reading", batch, tables)
    assert dml.insert("reading", batch.where("reading_id = 8"), tables).snapshot.count() == 4


def test_company_insert(spark, tables):
    new = spark.createDataFrame([("b", "t9", 0), ("a", "t8", 2)], "trade_name string, tax_id string, parent_company_id bigint")
    batch = dml.company_batch(tables["company"], new.withColumns({"city": F.lit("Z"), "industry": F.lit(None)}), ["trade_name"])
    got = dml.insert("company", batch, tables).snapshot.where("company_id > 3").orderBy("company_id").collect()
    assert [(r.company_id, r.trade_name, r.parent_company_id) for r in got] == [(4, "a", 2), (5, "b", None)]
    clash = batch.withColumn("tax_id", F.lit("t1"))
    with pytest.raises(dml.RuleViolation, match="unique"):
        dml.insert("company", clash, tables)
    # A new row may name a parent that arrives with it, but not one that exists nowhere.
    dml.insert("company", batch.withColumn("parent_company_id", F.lit(5)), tables)
    with pytest.raises(dml.RuleViolation, match="foreign key"):
        dml.insert("company", batch.withColumn("parent_company_id", F.lit(99)), tables)


def test_partial_update(spark, tables):
    changes = spark.createDataFrame([(1, "", "New"), (2, "Zwei", None)], "company_id bigint, trade_name string, city string")
    got = {r.company_id: (r.trade_name, r.city) for r in dml.update_companies(tables["company"], changes).snapshot.collect()}
    assert got == {1: ("One", "New"), 2: ("Zwei", "X"), 3: ("Three", "Y")}


def test_restricted_delete(spark, tables):
    ids = spark.createDataFrame([(1,), (2,), (3,), (44,)], "company_id bigint")
    children = [(tables["site"], "company_id"), (tables["company"], "parent_company_id")]
    change = dml.delete_unreferenced(tables["company"], ids, "company_id", children)
    assert [r.company_id for r in change.snapshot.collect()] == [1]
    assert change.affected().first().affected == 2


def test_status_update_logs_real_changes(spark, tables):
    changes = spark.createDataFrame([(1, "PENDING"), (2, "VALIDATED"), (99, "VALIDATED")], "reading_id bigint, status string")
    change = dml.update_status(tables["reading"], changes)
    want = [(2, "REJECTED", "VALIDATED")]
    assert [tuple(r) for r in change.transitions.collect()] == want
    assert [tuple(r) for r in dml.status_transitions(tables["reading"], change.snapshot).collect()] == want
    assert change.affected().first().affected == 2
    assert tables["reading"].count() == change.snapshot.count()
    with pytest.raises(dml.RuleViolation):
        dml.update_status(tables["reading"], changes.withColumn("status", F.lit("ODD")))


def test_routines(spark, tables):
    change = dml.reopen_rejected(tables["reading"])
    got = {r.reading_id: (r.measured_value, r.status) for r in change.snapshot.collect()}
    assert got == {1: (10.0, "PENDING"), 2: (0.0, "PENDING"), 3: (5000.0, "REJECTED")}
    settled = dml.settle_site(tables["reading"], 1, 1, "REJECTED")
    assert [tuple(r) for r in settled.transitions.collect()] == [(1, "PENDING", "REJECTED")]
    assert dml.settle_site(tables["reading"], 2, 1, "REJECTED").affected().first().affected == 0


def test_log_ids_continue(spark, tables):
    log = spark.createDataFrame([], TABLES["status_log"].schema)
    first = dml.log_rows(log, dml.reopen_rejected(tables["reading"]).transitions, "2026-01-01 10:00:00")
    second = dml.log_rows(first, dml.settle_site(tables["reading"], 1, 1, "VALIDATED").transitions, "2026-01-01 11:00:00")
    rows = dml.log_newest_first(first.unionByName(second)).collect()
    assert [(r.log_id, r.reading_id, r.changed_at.hour) for r in rows] == [(2, 1, 11), (1, 2, 10)]


def test_report_finds_each_violation(spark, tables):
    bad = tables["company"].unionByName(tables["company"].where("company_id = 1").withColumn("trade_name", F.lit(None).cast("string")))
    bad = bad.withColumn("parent_company_id", F.when(F.col("company_id") == 2, 50).otherwise(F.col("parent_company_id")))
    report = {(r.rule, r.columns): r.violations for r in rules.rule_report(bad, TABLES["company"], {"company": bad}).collect()}
    assert report == {("primary key", "company_id"): 1, ("unique", "tax_id"): 1, ("not null", "trade_name"): 1,
                      ("not null", "tax_id"): 0, ("foreign key", "parent_company_id"): 1}


def test_scalar_rules(spark):
    df = spark.createDataFrame([(100.0,), (100.01,), (500.0,), (500.01,), (None,)], "v double")
    got = [r[0] for r in df.select(impact_class("v")).collect()]
    assert got == [LOW_IMPACT, MODERATE_IMPACT, MODERATE_IMPACT, CRITICAL_IMPACT, CRITICAL_IMPACT]
    grades = spark.createDataFrame([(g,) for g in ("a", " AAA ", "bbb", "Bb", "B", "", None)], "g string")
    assert [r[0] for r in grades.select(status_from_grade("g")).collect()] == [
        "VALIDATED", "VALIDATED", "VALIDATED", "PENDING", "REJECTED", "REJECTED", "REJECTED"]


# --- tables ----------------------------------------------------------------------------------------------


def test_append_and_replace(spark, tables):
    path = scratch_path(spark, "tables")
    assert read_table(spark, "reading", path).count() == 0
    march, april = datetime(2022, 3, 5), datetime(2022, 4, 5)
    rows = readings(spark, (1, march, 1.0, "PENDING"), (2, april, 9000.0, "REJECTED"))
    append_rows(rows, "reading", path)
    append_rows(readings(spark, (3, None, 7000.0, "REJECTED")), "reading", path)
    got = read_table(spark, "reading", path)
    assert sorted(r.reading_id for r in got.collect()) == [1, 2, 3] and got.schema == TABLES["reading"].schema
    replace_rows(rows, "reading", path)
    assert read_table(spark, "reading", path).count() == 2
    replace_rows(tables["company"], "company", scratch_path(spark, "tables"))


def test_last_id(spark, tables):
    new = readings(spark, (7, datetime(2022, 3, 5), 1.0, "PENDING"), (9, datetime(2022, 3, 6), 2.0, "PENDING"))
    assert dml.Change(new, new).last_id("reading_id").first()[0] == 9
