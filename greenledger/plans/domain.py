"""The ESG relations derived from the star-schema test tables.

Each block is one relation; the text is read by Spark and by DuckDB alike. Traps built in: shared trade names,
missing sectors, companies without a site, idle auditors, orphan audits, audits without readings, malformed
dates, duplicate tickers, padded and missing grades.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import views
from ..operators.dashboard import Dashboard, build_dashboard
from ..session import apply_settings

SOURCES = ("customer", "nation", "orders", "supplier")

RELATIONS = {
    "category": """
select * from (values (1,'Environment','ENVIRONMENTAL'),(2,'Society','SOCIAL'),
(3,'Corporate governance','GOVERNANCE')) t(category_id,description,pillar)""",
    "metric": """
select * from (values (1,'Environment score','range 0-1000',1),(2,'Social score','range 0-1000',2),
(3,'Governance score','range 0-1000',3),(4,'Total score','range 0-3000',3))
t(metric_id,name,description,category_id)""",
    "company_src": """
select c_custkey company_id,
concat('Customer#',lpad(cast(c_custkey - case when c_custkey%50=49 then 1 else 0 end as varchar(20)),9,'0')) trade_name,
rpad(translate(sha1(c_name),'abcdef',''),14,'0') digits, n_name city,
case when c_custkey%97=0 then null else concat(c_mktsegment,' ',cast(c_nationkey%5 as varchar(20))) end industry,
case when c_custkey%10<>0 then c_custkey-c_custkey%10 end parent_company_id
from customer join nation on c_nationkey=n_nationkey""",
    "company": """
select company_id, trade_name, concat(substr(digits,1,2),'.',substr(digits,3,3),'.',substr(digits,6,3),'/',
substr(digits,9,4),'-',substr(digits,13,2)) tax_id, city, industry, parent_company_id from company_src""",
    "site": """
select 1 site_id, company_id, concat('HQ ',upper(trade_name)) site_name, city location
from company where company_id%7<>0""",
    "reading": """
select o_orderkey reading_id, o_orderdate read_at, o_totalprice/50 measured_value,
case o_orderstatus when 'F' then 'VALIDATED' when 'P' then 'PENDING' else 'REJECTED' end status,
1 site_id, o_custkey company_id, cast(o_orderkey%4+1 as int) metric_id from orders""",
    "auditor": """
select concat('AUD',lpad(cast(s_suppkey as varchar(20)),8,'0')) auditor_id, s_name name,
concat('LIC-',cast(s_nationkey as varchar(20))) license_no from supplier""",
    "audit_src": """
select cast(floor(c_custkey/6) as bigint)+1 audit_id, cast(d.dt as date) audit_date,
concat('Audit of ',c_name) final_opinion,
case when c_custkey%60=0 then 'AUD-ORPHAN'
else concat('AUD',lpad(cast((c_custkey*11)%((select count(*) from supplier)-3) as varchar(20)),8,'0')) end auditor_id,
c_custkey company_id
from customer join (select o_custkey k, max(o_orderdate) + interval '30' day dt from orders group by o_custkey) d
on k=c_custkey where c_custkey%6=0""",
    "audit": """
select audit_id, audit_date, final_opinion, auditor_id from audit_src""",
    "audit_reading": """
select audit_id, reading_id from audit_src a join reading r on a.company_id=r.company_id
where metric_id in (1,2) and audit_id%20<>0""",
    "raw_scores": """
select c_custkey*2 row_no, concat('t',cast(c_custkey as varchar(20))) ticker, c_name name, n_name exchange,
c_mktsegment industry,
case when c_custkey%11=0 then 'n/d' else concat(cast(c_custkey%28+1 as varchar(20)),'-04-2022') end last_processing_date,
cast((c_custkey*37)%1000 as double) environment_score, cast((c_custkey*53)%1000 as double) social_score,
cast((c_custkey*71)%1000 as double) governance_score,
cast((c_custkey*37)%1000+(c_custkey*53)%1000+(c_custkey*71)%1000 as double) total_score,
case when (c_custkey*37)%1000>=500 then 'A' when (c_custkey*37)%1000>=300 then ' bb ' else 'B' end environment_grade,
case when (c_custkey*53)%1000>=500 then 'BBB' when (c_custkey*53)%1000>=300 then 'BB' else null end social_grade,
case when (c_custkey*71)%1000>=500 then 'aaa' when (c_custkey*71)%1000>=300 then 'BB' else 'CCC' end governance_grade,
case when (c_custkey*37)%1000>=500 then 'AA' else 'BB' end total_grade
from customer join nation on c_nationkey=n_nationkey
union all
select c_custkey*2+1, concat('t',cast(c_custkey as varchar(20))), concat('DUP ',c_name), 'X', 'Y', '01-01-2020',
cast(0 as double), cast(0 as double), cast(0 as double), cast(0 as double), 'A', 'A', 'A', 'A'
from customer where c_custkey%9=0""",
}

# The same views in SQL, for the oracle only; on the Spark side they are DataFrame functions.
ORACLE_VIEWS = {
    "measure": """
select metric_id, metric.name metric_name, category.description category, pillar
from category join metric using (category_id)""",
    "reading_overview": """
select reading_id, read_at, measured_value, status, trade_name, tax_id, metric_name, category, pillar
from measure join reading using (metric_id) join company using (company_id)""",
    "audited": """
select audit_id, reading_id, measured_value, status from reading join audit_reading using (reading_id)
union all
select audit_id, null, null, null from audit where audit_id not in (select audit_id from audit_reading)""",
    "audit_detail": """
select audit_id, audit_date, final_opinion, name auditor_name, license_no, reading_id, measured_value, status
from audited join audit using (audit_id) left join auditor using (auditor_id)""",
    "dashboard_base": """
select reading_overview.*, industry from company join reading_overview using (trade_name)""",
}


def with_domain(sql: str, extra: str = "") -> str:
    """An oracle query with all relations in front of it as CTEs."""
    blocks = [f"{name} as ({text})" for name, text in {**RELATIONS, **ORACLE_VIEWS}.items()]
    if extra:
        blocks.append(extra)
    return "with " + ",\n".join(blocks) + "\n" + sql


class Domain:
    """The relations of one data folder as lazy DataFrames, found as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _relations(self) -> dict[str, DataFrame]:
        # Views are bound when a statement is analysed, so a later Domain may take the names over.
        for name in SOURCES:
            self.source(name).createOrReplaceTempView(name)
        out = {}
        for name, text in RELATIONS.items():
            out[name] = self.spark.sql(text)
            out[name].createOrReplaceTempView(name)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            return self._relations[name]
        raise AttributeError(name)

    def register_views(self) -> SparkSession:
        """Temp views for SQL texts, the two named views included."""
        for name, df in self._relations.items():
            df.createOrReplaceTempView(name)
        self.reading_overview.createOrReplaceTempView("reading_overview")
        self.audit_detail.createOrReplaceTempView("audit_detail")
        return self.spark

    @cached_property
    def reading_overview(self) -> DataFrame:
        return views.reading_overview(self.reading, self.company, self.metric, self.category)

    @cached_property
    def audit_detail(self) -> DataFrame:
        return views.audit_detail(self.audit, self.auditor, self.audit_reading, self.reading)

    @cached_property
    def base(self) -> Dashboard:
        return build_dashboard(self.reading, self.company, self.metric, self.category)

    @cached_property
    def base_rows(self) -> DataFrame:
        """Dashboard base with one row per reading and company of its name."""
        names = self.company.select(F.col("trade_name").alias("_name"), "industry")
        v = self.reading_overview
        return v.join(names, F.col("trade_name") == F.col("_name")).drop("_name")


_DOMAINS: dict[tuple[str, int, str], Domain] = {}


def domain_of(spark: SparkSession, sf_dir: str) -> Domain:
    """One Domain per session and folder: the plans are kept (never data), so files are listed once."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
    if key not in _DOMAINS:
        _DOMAINS[key] = Domain(apply_settings(spark), sf_dir)
    return _DOMAINS[key]
