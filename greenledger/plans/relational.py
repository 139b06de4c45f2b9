"""Sources, joins, sorted lists and the eight questions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import dml, views
from ..operators.dashboard import build_dashboard
from ..operators.ingest import model_tables
from ..schema import TABLES
from ..session import scratch_path
from ..sources.layout import read_clustered, write_clustered
from ..sources.scores import read_scores
from ..sources.seed import seed_tables
from ..sources.sql import query as run_sql
from ..sources.tables import append_rows, read_table, replace_rows
from .domain import Domain
from .registry import query

MEAN = "cast(sum(cast(measured_value as decimal(18,4))) as double)/count(measured_value)"

NAMED = """select reading_id, read_at, measured_value, status, trade_name, metric_name, pillar
from measure join reading using (metric_id) join company using (company_id)"""


# --- sources and sinks -----------------------------------------------------------------------------------


# Names as spreadsheets hold them: with quotes, commas and line breaks.
QUOTED_NAME = """case row_no%3 when 0 then concat('The "',name,'", Inc') when 1 then concat(name,chr(10),'second line') else name end"""


@query("s1_read_score_csv", f"select * replace ({QUOTED_NAME} as name) from raw_scores")
def _(d: Domain):
    path = scratch_path(d.spark, "score-file")
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = d.raw_scores.withColumn("name", F.expr(QUOTED_NAME))
    rows.write.options(header=True, quote='"', escape='"', **keep_blanks).csv(path)
    return read_scores(d.spark, path).withColumn("row_no", F.col("row_no.line"))


@query("s2_sql_text", "select status, count(*) readings from reading_overview group by status")
def _(d: Domain):
    return run_sql(d.register_views(), "select status, count(*) readings from reading_overview group by status")


@query("s3_positional_parameters", "select reading_id, status from reading where status='PENDING' and measured_value>1000")
def _(d: Domain):
    text = "select reading_id, status from reading where status=? and measured_value>?"
    return run_sql(d.register_views(), text, ("PENDING", 1000.0))


@query("s3_named_parameters", "select category description from measure where metric_id=2 and metric_id in (select metric_id from reading)")
def _(d: Domain):
    text = """select category.description from category left semi join metric
              on metric.category_id = category.category_id and metric.metric_id = :metric
              and metric.metric_id in (select distinct metric_id from reading)"""
    return run_sql(d.register_views(), text, {"metric": 2})


@query("s4_append_to_table", "select reading_id, measured_value, status from reading")
def _(d: Domain):
    path = scratch_path(d.spark, "append")
    early = F.year("read_at") < 1996
    append_rows(d.reading.where(early), "reading", path)
    append_rows(d.reading.where(~early), "reading", path)
    return read_table(d.spark, "reading", path).select("reading_id", "measured_value", "status")


@query("s5_seeded_dimensions", "select metric_id, metric_name name, pillar, (select count(*) from reading where reading.metric_id=measure.metric_id) readings from measure")
def _(d: Domain):
    seeds = seed_tables(d.spark)
    per_metric = d.reading.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        views.metric_pillars(seeds["metric"].drop("description"), seeds["category"])
        .join(per_metric, "metric_id", "left")
        .select("metric_id", "name", "pillar", F.coalesce("n", F.lit(0)).cast("bigint").alias("readings"))
    )


@query(
    "s6_rebuild_all_tables",
    """select 'company' table_name, count(distinct ticker) n from raw_scores
union all select 'site', count(distinct ticker) from raw_scores
union all select 'reading', 4*count(distinct ticker) from raw_scores
union all select 'audit', cast(ceil(count(distinct ticker)/6.0) as bigint) from raw_scores
union all select 'audit_reading', 2*cast(ceil(count(distinct ticker)/6.0) as bigint) from raw_scores""",
)
def _(d: Domain):
    root = scratch_path(d.spark, "rebuilt")
    for name, rows in {**seed_tables(d.spark), **model_tables(d.raw_scores, d.auditor)}.items():
        replace_rows(rows, name, f"{root}/{name}")
    out = None
    for name in ("company", "site", "reading", "audit", "audit_reading"):
        part = read_table(d.spark, name, f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("s7_view_capped", "select * from reading_overview order by reading_id limit 500")
def _(d: Domain):
    return d.register_views().table("reading_overview").orderBy("reading_id").limit(500)


@query("s7_audit_view_capped", "select * from audit_detail order by audit_id, reading_id nulls first limit 500")
def _(d: Domain):
    return d.register_views().table("audit_detail").orderBy("audit_id", "reading_id").limit(500)


@query("s8_table_capped", "select * from company order by company_id limit 200")
def _(d: Domain):
    return d.company.orderBy("company_id").limit(200)


@query("s9_company_names", "select company_id, trade_name from company order by trade_name, company_id")
def _(d: Domain):
    return d.company.select("company_id", "trade_name").orderBy("trade_name", "company_id")


@query("s9_used_metric_names", "select metric_id, metric_name name, category from measure where metric_id in (select metric_id from reading)")
def _(d: Domain):
    used = d.reading.select("metric_id").distinct()
    return views.metric_pillars(d.metric.drop("description"), d.category).join(used, "metric_id", "left_semi").select(
        "metric_id", "name", "category"
    )


# --- filters and projections -----------------------------------------------------------------------------


@query("f1_equality_filter", "select reading_id, measured_value from reading where status='PENDING'")
def _(d: Domain):
    return d.reading.where("status = 'PENDING'").select("reading_id", "measured_value")


@query("f4_missing_industry", "select company_id, trade_name from company where industry is null")
def _(d: Domain):
    return d.company.where(F.col("industry").isNull()).select("company_id", "trade_name")


@query("f4_null_drop", "select company_id, industry from company where industry is not null")
def _(d: Domain):
    return d.company.select("company_id", "industry").dropna(subset=["industry"])


@query("f5_composite_predicate", "select reading_id from reading where site_id=1 and company_id=(select max(company_id) from reading where status='PENDING') and status='PENDING'")
def _(d: Domain):
    last = d.reading.where("status = 'PENDING'").agg(F.max("company_id")).scalar()
    return d.reading.where(
        (F.col("site_id") == 1) & (F.col("company_id") == last) & (F.col("status") == "PENDING")
    ).select("reading_id")


@query(
    "f5_clustered_company_and_days",
    """select reading_id, read_at, measured_value, status from reading where company_id=(select max(company_id) from reading
where status='PENDING') and cast(read_at as date) between date '1995-01-01' and date '1997-06-30'""",
)
def _(d: Domain):
    path = scratch_path(d.spark, "clustered")
    write_clustered(d.reading, path, files=16)
    company = d.reading.where("status = 'PENDING'").agg(F.max("company_id")).first()[0]
    found = read_clustered(d.spark, path, company, date(1995, 1, 1), date(1997, 6, 30))
    return found.select("reading_id", "read_at", "measured_value", "status")


@query("f6_aliased_projection", "select reading_id id, read_at taken_at, measured_value amount, status review_state from reading")
def _(d: Domain):
    return d.reading.select(
        F.col("reading_id").alias("id"), F.col("read_at").alias("taken_at"), F.col("measured_value").alias("amount"),
        F.col("status").alias("review_state"),
    )


@query("f8_sector_list", "select distinct industry from company where industry is not null order by industry")
def _(d: Domain):
    return views.distinct_values(d.company, "industry")


@query("f8_company_list", "select distinct trade_name from company order by trade_name")
def _(d: Domain):
    return views.distinct_values(d.company, "trade_name")


# --- joins -----------------------------------------------------------------------------------------------


@query("j1_newest_readings", NAMED + " order by read_at desc, reading_id limit 200")
def _(d: Domain):
    return views.newest_readings(d.reading, d.company, d.metric, d.category)


@query("j1_all_readings_joined", NAMED)
def _(d: Domain):
    return views.newest_readings(d.reading, d.company, d.metric, d.category, limit=None)


@query("j2_sites_with_company", "select site_id, company_id, trade_name, site_name, location from company join site using (company_id)")
def _(d: Domain):
    return views.sites_with_company(d.site, d.company)


@query("j2_metric_readings_by_category", "select metric_id, metric_name name, category, pillar, readings from measure join (select metric_id, count(*) readings from reading group by metric_id) using (metric_id)")
def _(d: Domain):
    n = d.reading.groupBy("metric_id").agg(F.count(F.lit(1)).alias("readings"))
    dims = views.metric_pillars(d.metric.drop("description"), d.category)
    return dims.join(n, "metric_id").select("metric_id", "name", "category", "pillar", "readings")


@query(
    "j3_readings_with_site",
    """select reading_id, read_at, measured_value, status, trade_name, site_name, metric_name
from (select company_id, site_id, trade_name, site_name from company join site using (company_id))
join reading using (company_id, site_id) join measure using (metric_id)
order by read_at desc, reading_id limit 200""",
)
def _(d: Domain):
    return views.reading_list(d.reading, d.company, d.site, d.metric)


@query("j4_name_join_rows", "select reading_id, trade_name, pillar, measured_value, industry from dashboard_base")
def _(d: Domain):
    return d.base_rows.select("reading_id", "trade_name", "pillar", "measured_value", "industry")


@query("j4_name_join_collapsed", "select reading_id, trade_name, pillar, measured_value, industry, count(*) copies from dashboard_base group by all")
def _(d: Domain):
    return d.base.rows.select("reading_id", "trade_name", "pillar", "measured_value", "industry", "copies")


@query("j4_id_join", "select reading_id, trade_name, industry from reading join company using (company_id)")
def _(d: Domain):
    base = build_dashboard(d.reading, d.company, d.metric, d.category, key="company_id")
    return base.rows.select("reading_id", "trade_name", "industry")


@query("j5_audits_by_auditor", "select name, cast(coalesce(sum(held), 0) as bigint) audits from auditor left join (select auditor_id, count(*) held from audit group by auditor_id) using (auditor_id) group by name order by audits desc, name")
def _(d: Domain):
    return views.audits_by_auditor(d.auditor, d.audit)


@query("j6_audit_detail", "select * from audit_detail")
def _(d: Domain):
    return d.audit_detail


@query("j7_companies_without_site", "select company_id, trade_name, tax_id from company where not exists (select * from site where site.company_id=company.company_id)")
def _(d: Domain):
    return views.companies_without_site(d.company, d.site)


@query("j8_audited_metrics", "select metric_id, name, description from metric where exists (select * from audit_reading join reading using (reading_id) where reading.metric_id=metric.metric_id and status='VALIDATED')")
def _(d: Domain):
    return views.audited_metrics(d.metric, d.reading, d.audit_reading)


FULL = """select distinct auditor.name auditor_name, auditor.auditor_id, audit_id, audit_date
from audit full outer join auditor on audit.auditor_id=auditor.auditor_id"""


@query("j9_reconciled_auditors", FULL)
def _(d: Domain):
    return views.reconcile_auditors(d.auditor, d.audit)


@query("t6_union_distinct", FULL)
def _(d: Domain):
    people = d.auditor.select(F.col("name").alias("auditor_name"), "auditor_id")
    audits = d.audit.select("audit_id", "audit_date", F.col("auditor_id").alias("ref"))
    same = F.col("auditor_id") == F.col("ref")
    # The audits are the large side and always the left one, which Spark splits for a busy auditor.
    held = audits.join(people, same, "left").select("auditor_name", "auditor_id", "audit_id", "audit_date")
    idle = people.join(audits.select("ref").distinct(), same, "left_anti").select(
        "auditor_name", "auditor_id", F.lit(None).cast("bigint"), F.lit(None).cast("date"))
    return held.union(idle).distinct()


ABOVE = f"""select company_id, trade_name, mean_value from (select company_id, {MEAN} mean_value,
cast(sum(sum(cast(measured_value as decimal(18,4)))) over () as double)/sum(count(measured_value)) over () overall
from reading group by company_id) join company using (company_id) where mean_value > overall"""


@query("j10_companies_above_average", ABOVE)
def _(d: Domain):
    return views.above_average_companies(d.reading, d.company, limit=None)


@query("a4_top_companies_above_average", ABOVE + " order by mean_value desc, company_id limit 25")
def _(d: Domain):
    return views.above_average_companies(d.reading, d.company)


@query("j11_category_of_metric", "select p_partkey row_id, p_partkey%6 metric_id, coalesce(category,'Category not found') category from part left join measure on metric_id=p_partkey%6")
def _(d: Domain):
    rows = d.source("part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 6).alias("metric_id"))
    return views.metric_category(rows, d.metric, d.category)


@query("r2_category_of_reading", "select reading_id, coalesce(category,'Category not found') category from reading left join measure using (metric_id)")
def _(d: Domain):
    return views.metric_category(d.reading.select("reading_id", "metric_id"), d.metric, d.category).drop("metric_id")


# --- aggregates of the questions -------------------------------------------------------------------------


@query("a1_mean_by_pillar", f"select pillar, count(*) total, {MEAN} mean_value from reading_overview group by pillar")
def _(d: Domain):
    return views.mean_by_pillar(d.reading, d.metric, d.category)


@query("a2_pending_by_company", "select trade_name, count(*) readings from reading_overview where status='PENDING' group by trade_name order by readings desc, trade_name limit 20")
def _(d: Domain):
    return views.count_status_by_company(d.reading, d.company)


@query("a2_pending_by_company_all", "select trade_name, count(*) readings from reading_overview where status='PENDING' group by trade_name")
def _(d: Domain):
    return views.count_status_by_company(d.reading, d.company, limit=None)


@query("a3_audits_counting_idle", "select auditor_id, (select count(*) from audit where audit.auditor_id=auditor.auditor_id) audits from auditor")
def _(d: Domain):
    n = d.audit.groupBy("auditor_id").agg(F.count("audit_id").alias("n"))
    return d.auditor.join(n, "auditor_id", "left").select("auditor_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("audits"))


@query("a5_table_sizes", "select (select count(*) from company) companies, (select count(*) from reading) readings, (select count(*) from audit) audits")
def _(d: Domain):
    return views.table_sizes(companies=d.company, readings=d.reading, audits=d.audit)


@query("v1_reading_overview", "select * from reading_overview")
def _(d: Domain):
    return d.reading_overview


@query("v2_audit_detail_by_status", "select coalesce(status,'none') state, count(*) n, count(distinct audit_id) audits from audit_detail group by 1")
def _(d: Domain):
    return d.audit_detail.groupBy(F.coalesce("status", F.lit("none")).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("audit_id").alias("audits")
    )


# --- sorting and limits ----------------------------------------------------------------------------------


@query("t1_newest_reading_ids", "select reading_id, status from reading order by reading_id desc limit 50")
def _(d: Domain):
    return d.reading.select("reading_id", "status").orderBy(F.desc("reading_id")).limit(50)


@query("t1_sort_nulls_first", "select company_id, industry from company order by industry nulls first, company_id")
def _(d: Domain):
    return d.company.select("company_id", "industry").orderBy(F.asc_nulls_first("industry"), "company_id")


@query("t2_sites_capped", "select site_id, company_id, trade_name, site_name, location from company join site using (company_id) order by company_id, site_id limit 300")
def _(d: Domain):
    return views.sites_with_company(d.site, d.company).orderBy("company_id", "site_id").limit(300)


@query("t3_most_frequent_sectors", "select industry, count(*) n from dashboard_base where industry is not null group by industry order by n desc, industry limit 15")
def _(d: Domain):
    return d.base.top(15)


@query("t4_head_of_result", "select trade_name, count(*) readings from reading_overview where status='PENDING' group by trade_name order by readings desc, trade_name limit 25")
def _(d: Domain):
    return views.count_status_by_company(d.reading, d.company, limit=None).limit(25)


@query("r7_log_newest_first", "select row_number() over (order by reading_id) log_id, reading_id, 'REJECTED' old_status, 'PENDING' new_status from reading where status='REJECTED' and measured_value>5000")
def _(d: Domain):
    change = dml.reopen_rejected(d.reading)
    return dml.log_newest_first(dml.log_rows(empty_log(d), change.transitions, "2026-01-01 00:00:00")).drop(
        "changed_at", "changed_by"
    )


def empty_log(d: Domain):
    return d.spark.createDataFrame([], TABLES["status_log"].schema)
