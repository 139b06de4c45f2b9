"""Ingest steps over the wide score rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import processing_date, pseudo_tax_id, status_from_grade
from ..operators import ingest
from ..schema import SCORE_METRICS
from .domain import Domain
from .registry import query

LISTED = """listed as (select *,
coalesce(cast(try_strptime(last_processing_date,'%d-%m-%Y') as date), date '2022-04-19') "day"
from raw_scores qualify row_number() over (partition by ticker order by row_no)=1),
numbered as (select *, row_number() over (order by row_no) company_id from listed)"""
LONG = LISTED + """,
long as (select company_id, "day", metric, metric_id, score, grade from numbered, lateral (values
('environment_score',1,environment_score,environment_grade),('social_score',2,social_score,social_grade),
('governance_score',3,governance_score,governance_grade),('total_score',4,total_score,total_grade))
t(metric,metric_id,score,grade))"""
STATUS = """case when upper(trim(grade)) in ('A','AA','AAA','BBB') then 'VALIDATED'
when upper(trim(grade))='BB' then 'PENDING' else 'REJECTED' end"""
READINGS = LONG + f""",
loaded as (select (metric_id-1)*(select count(*) from numbered)+company_id reading_id, cast("day" as timestamp) read_at,
score measured_value, {STATUS} status, 1 site_id, company_id, metric_id from long)"""
PICKED = """picked as (select company_id, "day", name, (company_id-1)//6+1 audit_id from numbered where (company_id-1)%6=0)"""
DRAW = """cast(concat('0x',substr(md5(concat('42:',cast(audit_id as varchar))),1,8)) as bigint)"""


@query("i1_first_row_per_ticker", "select * from raw_scores qualify row_number() over (partition by ticker order by row_no)=1")
def _(d: Domain):
    return ingest.first_per_key(d.raw_scores, "ticker", "row_no")


@query("i2_dense_ids", "select ticker, company_id from numbered", LISTED)
def _(d: Domain):
    return ingest.listed_companies(d.raw_scores).select("ticker", "company_id")


@query("i3_processing_dates", """select ticker, row_no, coalesce(cast(try_strptime(last_processing_date,'%d-%m-%Y') as date), date '2022-04-19') "day" from raw_scores""")
def _(d: Domain):
    return d.raw_scores.select("ticker", "row_no", processing_date("last_processing_date").alias("day"))


@query(
    "i4_company_rows",
    """select company_id, name trade_name, concat(substr(g,1,2),'.',substr(g,3,3),'.',substr(g,6,3),'/',substr(g,9,4),'-',
substr(g,13,2)) tax_id, exchange city, industry, cast(null as bigint) parent_company_id
from (select *, rpad(translate(sha1(ticker),'abcdef',''),14,'0') g from numbered)""",
    LISTED,
)
def _(d: Domain):
    return ingest.company_rows(ingest.listed_companies(d.raw_scores))


@query("i5_site_rows", "select 1 site_id, company_id, concat('HQ ',upper(ticker)) site_name, exchange location from numbered", LISTED)
def _(d: Domain):
    return ingest.site_rows(ingest.listed_companies(d.raw_scores))


@query("i6_pseudo_tax_ids", "select company_id, tax_id from company")
def _(d: Domain):
    customers = d.source("customer")
    return customers.select(F.col("c_custkey").alias("company_id"), pseudo_tax_id("c_name").alias("tax_id"))


@query("i7_unpivot_scores", "select row_no, metric, score from (unpivot (select row_no, environment_score, social_score, governance_score, total_score from raw_scores) on environment_score, social_score, governance_score, total_score into name metric value score)")
def _(d: Domain):
    return ingest.unpivot(d.raw_scores, ["row_no"], [s for _, s, _ in SCORE_METRICS], "score")


@query("i8_unpivot_grades", "select row_no, metric, grade from raw_scores unpivot include nulls (grade for metric in (environment_grade, social_grade, governance_grade, total_grade))")
def _(d: Domain):
    return ingest.unpivot(d.raw_scores, ["row_no"], [g for _, _, g in SCORE_METRICS], "grade")


@query("i9_renamed_metrics", "select row_no, replace(metric,'_grade','_score') metric from raw_scores unpivot include nulls (grade for metric in (environment_grade, social_grade, governance_grade, total_grade))")
def _(d: Domain):
    long = ingest.unpivot(d.raw_scores, ["row_no"], [g for _, _, g in SCORE_METRICS], "grade")
    return long.select("row_no", F.replace("metric", F.lit("_grade"), F.lit("_score")).alias("metric"))


@query("i10_scores_with_grades", """select company_id, "day", metric, metric_id, score, grade from long""", LONG)
def _(d: Domain):
    return ingest.score_and_grade(ingest.listed_companies(d.raw_scores))


@query("i10_j12_joined_unpivots", """select company_id, "day", metric, score, grade from long""", LONG)
def _(d: Domain):
    return ingest.joined_score_and_grade(ingest.listed_companies(d.raw_scores))


@query("i11_metric_numbers", "select metric, metric_id, count(*) n from long group by all", LONG)
def _(d: Domain):
    long = ingest.unpivot(ingest.listed_companies(d.raw_scores), ["company_id"], [s for _, s, _ in SCORE_METRICS], "score")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).withColumn("metric_id", ingest.metric_number("metric"))


@query("i12_status_from_grade", f"select grade, {STATUS} status, count(*) n from long group by all", LONG)
def _(d: Domain):
    long = ingest.score_and_grade(ingest.listed_companies(d.raw_scores))
    return long.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).withColumn("status", status_from_grade("grade"))


@query("i13_formatted_dates", """select company_id, strftime(cast("day" as timestamp),'%Y-%m-%d %H:%M:%S') read_text from numbered""", LISTED)
def _(d: Domain):
    listed = ingest.listed_companies(d.raw_scores)
    return listed.select(
        "company_id", F.date_format(F.col("day").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("read_text")
    )


@query("i13_loaded_readings", "select * from loaded", READINGS)
def _(d: Domain):
    return ingest.reading_rows(ingest.listed_companies(d.raw_scores))


@query("i14_every_sixth_company", "select company_id, audit_id from picked", LISTED + ",\n" + PICKED)
def _(d: Domain):
    audits = ingest.sampled_audits(ingest.listed_companies(d.raw_scores), d.auditor)
    return audits.select("company_id", "audit_id")


@query("i15_audit_dates", """select audit_id, "day"+30 audit_date, concat('ESG audit ',name) final_opinion from picked""", LISTED + ",\n" + PICKED)
def _(d: Domain):
    audits = ingest.sampled_audits(ingest.listed_companies(d.raw_scores), d.auditor)
    return audits.select("audit_id", "audit_date", "final_opinion")


@query(
    "i16_assigned_auditors",
    "select audit_id, auditor_id from drawn join ranked on pick=rank",
    LISTED + ",\n" + PICKED + f""",
drawn as (select audit_id, {DRAW}%(select count(*) from auditor) pick from picked),
ranked as (select auditor_id, row_number() over (order by auditor_id)-1 "rank" from auditor)""",
)
def _(d: Domain):
    audits = ingest.sampled_audits(ingest.listed_companies(d.raw_scores), d.auditor)
    return audits.select("audit_id", "auditor_id")


@query("i17_audit_links", "select audit_id, reading_id from picked join loaded using (company_id) where metric_id in (1,2)", READINGS + ",\n" + PICKED)
def _(d: Domain):
    listed = ingest.listed_companies(d.raw_scores)
    return ingest.audit_links(ingest.sampled_audits(listed, d.auditor), ingest.reading_rows(listed))
