"""Inserts, updates, deletes, rules and the change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml, rules
from ..schema import TABLES, ForeignKey
from ..session import scratch_path
from ..sources.tables import read_table, replace_rows
from .domain import Domain
from .registry import query
from .relational import empty_log

NOW = "2026-01-01 00:00:00"


# --- batches derived from the tables ---------------------------------------------------------------------


def new_companies(d: Domain):
    """One new company per supplier; every second names parent 0."""
    rows = d.source("supplier").select(
        F.col("s_suppkey").alias("rank"),
        F.concat(F.lit("New "), "s_name").alias("trade_name"),
        F.concat(F.lit("TAX-"), F.col("s_suppkey").cast("string")).alias("tax_id"),
        F.lit("NATION_0").alias("city"),
        F.lit("BUILDING 0").alias("industry"),
        F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(10).cast("bigint").alias("parent_company_id"),
    )
    return dml.company_batch(d.company, rows, ["rank"])


COMPANIES = """batch as (select (select max(company_id) from company)+row_number() over (order by s_suppkey) company_id,
concat('New ',s_name) trade_name, concat('TAX-',cast(s_suppkey as varchar)) tax_id, 'NATION_0' city, 'BUILDING 0' industry,
case when s_suppkey%2<>0 then cast(10 as bigint) end parent_company_id from supplier)"""


def new_sites(d: Domain):
    return d.site.select(
        F.lit(2).alias("site_id"), "company_id", F.concat(F.lit("Annex "), "site_name").alias("site_name"), "location"
    )


def new_metrics(d: Domain):
    """One new metric per nation, spread over the categories."""
    rows = d.source("nation").select(
        "n_nationkey", F.col("n_name").alias("name"), F.lit("national").alias("description"),
        (F.col("n_nationkey") % 3 + 1).cast("int").alias("category_id"),
    )
    return dml.metric_batch(d.metric, rows, ["n_nationkey"])


METRICS = """batch as (select cast(4+row_number() over (order by n_nationkey) as int) metric_id, n_name name,
'national' description, cast(n_nationkey%3+1 as int) category_id from nation)"""


def new_readings(d: Domain):
    """A follow-up reading for every company with a site, on the day after its last one."""
    last = d.reading.groupBy("company_id").agg(F.max("read_at").alias("at"), F.max("measured_value").alias("measured_value"))
    rows = d.site.select("site_id", "company_id").join(last, "company_id").select(
        F.date_add(F.col("at").cast("date"), 1).alias("day"), "measured_value", F.lit("PENDING").alias("status"),
        "site_id", "company_id", F.lit(1).alias("metric_id"),
    )
    return dml.reading_batch(d.reading, rows, ["company_id"])


READINGS = """batch as (select (select max(reading_id) from reading)+row_number() over (order by company_id) reading_id,
cast(cast(last_at as date)+1 as timestamp)+interval 9 hour read_at, v measured_value, 'PENDING' status, s.site_id,
company_id, 1 metric_id from site s
join (select company_id, max(read_at) last_at, max(measured_value) v from reading group by 1) using (company_id))"""


def with_reading_tables(d: Domain) -> dict:
    return {n: getattr(d, n) for n in ("company", "site", "metric", "category", "reading")}


@query("d1_insert_companies", "select * from company union all select * from batch", COMPANIES)
def _(d: Domain):
    return dml.insert("company", new_companies(d), {"company": d.company}).snapshot


BROKEN = """,
broken as (select case when company_id%4=0 then 1 else company_id end company_id,
case when company_id%5=0 then null else trade_name end trade_name, case when company_id%7=0 then 'twice' else tax_id end tax_id,
case when company_id%3=0 then company_id+1000000 else parent_company_id end parent_company_id from batch)"""


@query(
    "d1_insert_report",
    """select 'company' table_name, rule, columns, violations from (
select 'primary key' rule, 'company_id' columns, (select count(*) from (select company_id from broken group by 1 having count(*)>1))
+(select count(*) from broken where company_id in (select company_id from company)) violations
union all select 'unique','tax_id',(select count(*) from (select tax_id from broken where tax_id is not null group by 1 having count(*)>1))
+(select count(*) from broken where tax_id in (select tax_id from company))
union all select 'not null','trade_name',(select count(*) from broken where trade_name is null)
union all select 'not null','tax_id',(select count(*) from broken where tax_id is null)
union all select 'foreign key','parent_company_id',(select count(*) from broken where parent_company_id is not null
and parent_company_id not in (select company_id from company union all select company_id from broken)))""",
    COMPANIES + BROKEN,
)
def _(d: Domain):
    """New companies with repeated and taken keys, missing names and unknown parents."""
    i, keep = F.col("company_id"), F.col
    broken = new_companies(d).withColumns({
        "company_id": F.when(i % 4 == 0, 1).otherwise(i),
        "trade_name": F.when(i % 5 != 0, keep("trade_name")),
        "tax_id": F.when(i % 7 == 0, "twice").otherwise(keep("tax_id")),
        "parent_company_id": F.when(i % 3 == 0, i + 1_000_000).otherwise(keep("parent_company_id")),
    })
    return rules.rule_report(broken, TABLES["company"], {"company": d.company}, existing=d.company)


@query("d2_insert_sites", "select site_id, company_id, site_name, location from site union all select 2, company_id, concat('Annex ',site_name), location from site")
def _(d: Domain):
    return dml.insert("site", new_sites(d), {"company": d.company, "site": d.site}).snapshot


@query("d3_insert_metrics", "select * from metric union all select * from batch", METRICS)
def _(d: Domain):
    return dml.insert("metric", new_metrics(d), {"metric": d.metric, "category": d.category}).snapshot


@query("d4_insert_readings", "select * from reading union all select * from batch", READINGS)
def _(d: Domain):
    return dml.insert("reading", new_readings(d), with_reading_tables(d)).snapshot


@query(
    "d5_partial_update",
    """select company_id, case when company_id%2=0 then concat('Renamed ',company_id) else trade_name end trade_name,
tax_id, case when company_id%3=0 then 'X' else city end city, industry, parent_company_id from company""",
)
def _(d: Domain):
    changes = d.company.select(
        "company_id",
        F.when(F.col("company_id") % 2 == 0, F.concat(F.lit("Renamed "), F.col("company_id").cast("string"))).otherwise("").alias("trade_name"),
        F.when(F.col("company_id") % 3 == 0, "X").alias("city"),
    )
    return dml.update_companies(d.company, changes).snapshot


LOOSE = """select company_id from company c where company_id%10<>5 and not exists (select 1 from site s where s.company_id=c.company_id)
and not exists (select 1 from company k where k.parent_company_id=c.company_id)"""


def deletion(d: Domain):
    ids = d.company.where(F.col("company_id") % 10 != 5)
    children = [(d.site, "company_id"), (d.company, "parent_company_id")]
    return ids, children, dml.delete_unreferenced(d.company, ids, "company_id", children)


@query("d6_restricted_delete", f"select * from company where company_id not in ({LOOSE})")
def _(d: Domain):
    return deletion(d)[2].snapshot


@query("d6_blocked_deletes", f"select company_id from company where company_id%10<>5 and company_id not in ({LOOSE})")
def _(d: Domain):
    ids, children, _ = deletion(d)
    return dml.referenced_keys(ids, "company_id", children)


def review(d: Domain):
    """Every reading of metric 2 is validated."""
    changes = d.reading.where("metric_id = 2").select("reading_id", F.lit("VALIDATED").alias("status"))
    return dml.update_status(d.reading, changes)


@query("d7_update_status", "select reading_id, case when metric_id=2 then 'VALIDATED' else status end status from reading")
def _(d: Domain):
    return review(d).snapshot.select("reading_id", "status")


@query("d8_affected_rows", "select count(*) affected from reading where metric_id=2")
def _(d: Domain):
    return review(d).affected()


@query("d9_committed_versions", "select 1 version, count(*) filter (status='REJECTED') rejected, 0::bigint logged from reading union all select 2, count(*) filter (status='REJECTED' and measured_value<=5000), count(*) filter (status='REJECTED' and measured_value>5000) from reading")
def _(d: Domain):
    root = scratch_path(d.spark, "versions")
    change = dml.reopen_rejected(d.reading)
    log = dml.log_rows(empty_log(d), change.transitions, NOW)
    replace_rows(d.reading, "reading", f"{root}/1/reading")
    replace_rows(change.snapshot, "reading", f"{root}/2/reading")
    replace_rows(log, "status_log", f"{root}/2/status_log")
    out = None
    for version in (1, 2):
        rejected = read_table(d.spark, "reading", f"{root}/{version}/reading").where("status = 'REJECTED'")
        logged = read_table(d.spark, "status_log", f"{root}/{version}/status_log")
        part = d.spark.range(1).select(
            F.lit(version).alias("version"), rejected.agg(F.count(F.lit(1))).scalar().alias("rejected"),
            logged.agg(F.count(F.lit(1))).scalar().alias("logged"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("d8_last_inserted_id", "select max(reading_id) last_id from (select * from reading union all select * from batch)", READINGS)
def _(d: Domain):
    return dml.insert("reading", new_readings(d), with_reading_tables(d)).last_id("reading_id")


# --- rules -----------------------------------------------------------------------------------------------


@query("c1_duplicate_primary_keys", "select ticker, count(*) copies from raw_scores group by ticker having count(*)>1")
def _(d: Domain):
    return rules.duplicate_keys(d.raw_scores, ["ticker"])


@query("c1_duplicate_composite_keys", "select site_id, company_id, count(*) copies from reading group by all having count(*)>1")
def _(d: Domain):
    return rules.duplicate_keys(d.reading, ["site_id", "company_id"])


@query("c2_next_ids", "select company_id, trade_name from batch", COMPANIES)
def _(d: Domain):
    return new_companies(d).select("company_id", "trade_name")


@query("c3_unique_names", "select industry, city, count(*) copies from company where industry is not null group by all having count(*)>1")
def _(d: Domain):
    return rules.duplicate_keys(d.company, ["industry", "city"])


@query("c3_unique_tax_ids", "select tax_id, 2::bigint copies from company where company_id%10=3")
def _(d: Domain):
    """Every tenth company entered twice."""
    return rules.duplicate_keys(d.company.unionByName(d.company.where("company_id % 10 = 3")), ["tax_id"])


@query("c4_null_counts", "select count(*)-count(trade_name) trade_name, count(*)-count(industry) industry, count(*)-count(parent_company_id) parent_company_id from company")
def _(d: Domain):
    return rules.null_counts(d.company, ["trade_name", "industry", "parent_company_id"])


@query("c5_outside_domain", "select row_no, social_grade from raw_scores where social_grade not in ('A','BBB')")
def _(d: Domain):
    return rules.outside_domain(d.raw_scores, "social_grade", ["A", "BBB"]).select("row_no", "social_grade")


@query("c5_status_domain", "select reading_id from reading where reading_id%11=0")
def _(d: Domain):
    """Every eleventh reading in lower case, which is no allowed status."""
    rows = d.reading.withColumn("status", F.when(F.col("reading_id") % 11 == 0, F.lower("status")).otherwise(F.col("status")))
    return rules.outside_domain(rows, "status", TABLES["reading"].domains["status"]).select("reading_id")


@query("c6_orphan_audits", "select audit_id, auditor_id from audit where auditor_id not in (select auditor_id from auditor)")
def _(d: Domain):
    return rules.orphans(d.audit, TABLES["audit"].foreign_keys[0], d.auditor).select("audit_id", "auditor_id")


@query("c6_readings_without_site", "select reading_id, company_id from reading r where not exists (select 1 from site s where s.site_id=r.site_id and s.company_id=r.company_id)")
def _(d: Domain):
    return rules.orphans(d.reading, TABLES["reading"].foreign_keys[0], d.site).select("reading_id", "company_id")


@query("c7_missing_parents", "select company_id, parent_company_id from company where parent_company_id is not null and (parent_company_id%20=0 or parent_company_id not in (select company_id from company))")
def _(d: Domain):
    """Every second parent is missing."""
    key: ForeignKey = TABLES["company"].foreign_keys[0]
    return rules.orphans(d.company, key, d.company.where("company_id % 20 <> 0")).select("company_id", "parent_company_id")


@query("c8_default_time", "select reading_id, timestamp '2026-01-01 00:00:00' changed_at, 'greenledger' changed_by from reading where status='REJECTED' and measured_value>5000")
def _(d: Domain):
    log = dml.log_rows(empty_log(d), dml.reopen_rejected(d.reading).transitions, NOW)
    return log.select("reading_id", "changed_at", "changed_by")


@query(
    "rule_report",
    """select 'company' table_name, 'primary key' rule, 'company_id' columns,
(select count(*) from (select company_id from company group by 1 having count(*)>1)) violations
union all select 'company','unique','tax_id', (select count(*) from (select tax_id from company group by 1 having count(*)>1))
union all select 'company','not null',* from (unpivot (select count(*)-count(trade_name) trade_name, count(*)-count(tax_id) tax_id from company) on trade_name, tax_id)
union all select 'company','foreign key','parent_company_id',(select count(*) from company c where parent_company_id is not null and parent_company_id not in (select company_id from company))
union all select 'reading','primary key','reading_id',(select count(*) from (select reading_id from reading group by 1 having count(*)>1))
union all select 'reading','not null',* from (unpivot (select count(*)-count(read_at) read_at, count(*)-count(measured_value) measured_value,
count(*)-count(status) status, count(*)-count(site_id) site_id, count(*)-count(company_id) company_id, count(*)-count(metric_id) metric_id
from reading) on read_at, measured_value, status, site_id, company_id, metric_id)
union all select 'reading','check','status',(select count(*) from reading where status not in ('PENDING','VALIDATED','REJECTED'))
union all select 'reading','foreign key','site_id,company_id',(select count(*) from reading where company_id not in (select company_id from site))
union all select 'reading','foreign key','metric_id',(select count(*) from reading where metric_id not in (select metric_id from metric))
union all select 'audit','primary key','audit_id',(select count(*) from (select audit_id from audit group by 1 having count(*)>1))
union all select 'audit','not null',* from (unpivot (select count(*)-count(audit_date) audit_date, count(*)-count(auditor_id) auditor_id from audit) on audit_date, auditor_id)
union all select 'audit','foreign key','auditor_id',(select count(*) from audit where auditor_id not in (select auditor_id from auditor))""",
)
def _(d: Domain):
    tables = {**with_reading_tables(d), "auditor": d.auditor, "audit": d.audit}
    report = None
    for name in ("company", "reading", "audit"):
        part = rules.rule_report(tables[name], TABLES[name], tables)
        report = part if report is None else report.unionByName(part)
    return report


# --- guard, log and routines -----------------------------------------------------------------------------

SHIFTED = "shifted as (select reading_id, measured_value-2000 measured_value from reading)"


def shifted(d: Domain):
    return d.reading.withColumn("measured_value", F.col("measured_value") - 2000)


@query("r3_rejected_inserts", "select reading_id, 'measured_value is negative' reason from shifted where measured_value<0", SHIFTED)
def _(d: Domain):
    return rules.split_by_rules(shifted(d), TABLES["reading"])[1].select("reading_id", "reason")


@query("r3_strict_batches", """select company_id, count(*) rows, count(*) filter (shifted.measured_value<0) broken,
case when count(*) filter (shifted.measured_value<0)=0 then count(*) else 0 end accepted
from shifted join reading using (reading_id) group by company_id""", SHIFTED)
def _(d: Domain):
    return rules.strict_batches(shifted(d), TABLES["reading"], "company_id")


@query("r3_accepted_inserts", "select reading_id, measured_value from shifted where measured_value>=0", SHIFTED)
def _(d: Domain):
    return rules.split_by_rules(shifted(d), TABLES["reading"])[0].select("reading_id", "measured_value")


@query("r4_status_transitions", "select reading_id, status old_status, 'VALIDATED' new_status from reading where metric_id=2 and status<>'VALIDATED'")
def _(d: Domain):
    return dml.status_transitions(d.reading, review(d).snapshot)


@query("r4_logged_transitions", "select row_number() over (order by reading_id) log_id, reading_id, status old_status, 'VALIDATED' new_status from reading where metric_id=2 and status<>'VALIDATED'")
def _(d: Domain):
    return dml.log_rows(empty_log(d), review(d).transitions, NOW).drop("changed_at", "changed_by")


BUSIEST = """(select company_id from reading where status='PENDING' group by 1 order by count(*) desc, company_id limit 1)"""


def settled(d: Domain):
    """The company with most pending readings is settled; its id is one row."""
    top = d.reading.where("status = 'PENDING'").groupBy("company_id").count().orderBy(F.desc("count"), "company_id")
    return dml.settle_site(d.reading, 1, top.first()["company_id"], "VALIDATED")


@query("r5_settled_site", f"select reading_id, case when site_id=1 and company_id={BUSIEST} and status='PENDING' then 'VALIDATED' else status end status from reading")
def _(d: Domain):
    return settled(d).snapshot.select("reading_id", "status")


@query("r5_settled_count", f"select count(*) affected from reading where company_id={BUSIEST} and status='PENDING'")
def _(d: Domain):
    return settled(d).affected()


@query("r6_reopened_readings", "select reading_id, read_at, case when hit then 0.0::double else measured_value end measured_value, case when hit then 'PENDING' else status end status, site_id, company_id, metric_id from (select *, status='REJECTED' and measured_value>5000 hit from reading)")
def _(d: Domain):
    return dml.reopen_rejected(d.reading).snapshot


@query("r6_reopened_count", "select count(*) affected from reading where status='REJECTED' and measured_value>5000")
def _(d: Domain):
    return dml.reopen_rejected(d.reading).affected()
