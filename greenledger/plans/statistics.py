"""Statistics of the dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.columns import impact_class, month_of, one_place, processing_date, pseudo_tax_id, status_from_grade
from ..operators import dml, profile, sketches
from ..session import checkpointed
from .domain import Domain
from .registry import query
from .relational import MEAN, empty_log

V = "measured_value"
OVERALL = f"stats as (select {MEAN} m from dashboard_base)"


def rounded(df, places: int, *columns: str):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- filters ---------------------------------------------------------------------------------------------

FILTERS = """industry in ('BUILDING 1','FURNITURE 2','MACHINERY 0') and pillar in ('SOCIAL','GOVERNANCE')
and status in ('VALIDATED','PENDING')"""


@query("f2_optional_filters", f"select pillar, status, count(*) readings from dashboard_base where {FILTERS} group by all")
def _(d: Domain):
    kept = d.base.filter(
        industries=["BUILDING 1", "FURNITURE 2", "MACHINERY 0"],
        pillars=["SOCIAL", "GOVERNANCE"],
        statuses=["VALIDATED", "PENDING"],
    )
    return profile.count_by(kept, "pillar", "status")


@query("f2_no_filter", "select pillar, count(*) readings from dashboard_base group by pillar")
def _(d: Domain):
    return profile.count_by(d.base.filter(), "pillar")


@query("f3_date_range", "select status, count(*) readings from dashboard_base where cast(read_at as date) between date '1995-03-01' and date '1996-06-30' group by status")
def _(d: Domain):
    return profile.count_by(
        d.base.filter(first_day=date(1995, 3, 1), last_day=date(1996, 6, 30)), "status"
    )


# --- single figures --------------------------------------------------------------------------------------


@query("a6_distinct_counts", "select count(distinct trade_name) companies, count(distinct industry) industries from dashboard_base")
def _(d: Domain):
    return profile.distinct_counts(d.base)


@query(
    "a6_distinct_companies_by_year",
    """select strftime(read_at,'%Y') as year, pillar, count(distinct trade_name) companies, true near from dashboard_base
where status in ('VALIDATED','PENDING') and read_at is not null group by 1, 2""",
)
def _(d: Domain):
    """Companies per year and pillar from united monthly sketches, held to the exact counts: within three standard errors."""
    year = F.substring("month", 1, 4)
    kept = sketches.company_sketches(d.base).withColumn("year", year)
    guess = sketches.distinct_companies(kept, "year", "pillar", where=F.col("status").isin("VALIDATED", "PENDING"))
    chosen = d.base.filter(statuses=["VALIDATED", "PENDING"]).with_facts(year=F.date_format("read_at", "yyyy"))
    pairs = chosen.facts.select("company_id", "year", "pillar").distinct().join(
        d.base.labels.select("company_id", "trade_name").distinct(), "company_id"
    )
    exact = pairs.select("year", "pillar", "trade_name").distinct().groupBy("year", "pillar").agg(
        F.count("trade_name").alias("companies")
    )
    error = F.abs(F.col("guess") - F.col("companies"))
    both = exact.join(guess.withColumnRenamed("companies", "guess"), ["year", "pillar"])
    return both.select("year", "pillar", "companies", (error <= F.col("companies") * 0.05 + 1).alias("near"))


@query("a7_count_by_pillar", "select pillar, count(*) readings from dashboard_base group by pillar")
def _(d: Domain):
    return profile.count_by(d.base, "pillar")


@query("a7_count_by_status", "select status, count(*) readings from dashboard_base group by status")
def _(d: Domain):
    return profile.count_by(d.base, "status")


@query("a8_validated_percent", "select 100.0::double*count(*) filter (status='VALIDATED')/count(*) validated_percent from dashboard_base")
def _(d: Domain):
    return profile.counted(d.base).select("validated_percent")


@query("a8_status_shares", "select status, count(*) readings, 100.0::double*count(*)/(select count(*) from dashboard_base) \"percent\" from dashboard_base group by status")
def _(d: Domain):
    return profile.share_by(d.base, "status")


@query("a9_mean", f"select {MEAN} mean_value from dashboard_base")
def _(d: Domain):
    return profile.moments(d.base).select("mean_value")


@query("a10_median", "select round(median(measured_value),6) median from dashboard_base")
def _(d: Domain):
    return rounded(profile.medians(d.base), 6, "median")


@query("a10_median_by_pillar", "select pillar, round(median(measured_value),6) median from dashboard_base group by pillar")
def _(d: Domain):
    return rounded(profile.medians(d.base, "pillar"), 6, "median")


@query(
    "a10_approximate_median_by_sector",
    """select industry, round(median(measured_value),6) median, true near_value, true near_rank from dashboard_base
where industry is not null group by industry""",
)
def _(d: Domain):
    """Medians from merged sketches, held to the exact ones: by value, and by the share of rows below them."""
    exact = profile.medians(d.base, "industry")
    guess = checkpointed(profile.approximate_medians(d.base, "industry").withColumnRenamed("median", "guess"))
    both = exact.join(guess, "industry")
    totals = d.base.totals("industry").select("industry", "n")
    labels = d.base.labels.join(F.broadcast(guess), "industry")
    below = (
        d.base.facts.join(labels, "company_id")
        .groupBy("industry").agg(
            F.sum(F.when(F.col(V) < F.col("guess"), F.col("copies")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col(V) <= F.col("guess"), F.col("copies")).otherwise(0)).alias("upto"),
        )
    )
    # The middle lies between the rows below the value and those up to it; either share is off by 2 % at most.
    near_rank = (F.col("below") / F.col("n") <= 0.52) & (F.col("upto") / F.col("n") >= 0.48)
    return both.join(totals, "industry").join(below, "industry").select(
        "industry", F.round("median", 6).alias("median"),
        (F.abs(F.col("guess") - F.col("median")) <= F.col("median") / 100).alias("near_value"), near_rank.alias("near_rank"),
    )


@query("a11_mode", "select round_even(measured_value,1) mode_value, count(*) n from dashboard_base group by 1 order by n desc, mode_value limit 1")
def _(d: Domain):
    return profile.mode(d.base)


@query("a12_spread", "select round(stddev_samp(measured_value),6) sd, round(var_samp(measured_value),4) variance from dashboard_base")
def _(d: Domain):
    return rounded(rounded(profile.moments(d.base).select("sd", "variance"), 6, "sd"), 4, "variance")


@query("a12_spread_by_sector", "select industry, count(*) readings, round(stddev_samp(measured_value),6) sd from dashboard_base where industry is not null group by industry")
def _(d: Domain):
    return rounded(profile.moments(d.base, "industry").select("industry", "readings", "sd"), 6, "sd")


@query("a13_skewness", "select round(avg(pow(measured_value-m,3))/pow(avg(pow(measured_value-m,2)),1.5),6) skewness from dashboard_base, stats", OVERALL)
def _(d: Domain):
    return rounded(profile.moments(d.base).select("skewness"), 6, "skewness")


@query("a14_kurtosis", "select round(kurtosis_pop(measured_value),6) kurtosis from dashboard_base")
def _(d: Domain):
    return rounded(profile.moments(d.base).select("kurtosis"), 6, "kurtosis")


@query(
    "a14_shape_by_pillar",
    """select pillar, round(avg(pow(measured_value-m,3))/pow(avg(pow(measured_value-m,2)),1.5),6) skewness,
round(avg(pow(measured_value-m,4))/pow(avg(pow(measured_value-m,2)),2)-3,6) kurtosis
from dashboard_base join means using (pillar) group by pillar""",
    f"means as (select pillar, {MEAN} m from dashboard_base group by pillar)",
)
def _(d: Domain):
    return rounded(profile.moments(d.base, "pillar").select("pillar", "skewness", "kurtosis"), 6, "skewness", "kurtosis")


# The 97.5 % quantile of t by its expansion around the normal one in powers of 1 / df.
INTERVAL = f"""whole as (select count(measured_value) n, {MEAN} m, stddev_samp(measured_value)/sqrt(count(measured_value)) se
from dashboard_base),
near as (select *, 1.959963984540054::double z, 1.0::double/(n-1) r from whole),
half as (select *, se*(z+(z**3+z)*r/4+(5*z**5+16*z**3+3*z)*r*r/96+(3*z**7+19*z**5+17*z**3-15*z)*r*r*r/384) h from near)"""


@query("a15_mean_interval", "select n readings, round(m,6) mean_value, round(se,6) standard_error, round(m-h,6) ci_low, round(m+h,6) ci_high from half", INTERVAL)
def _(d: Domain):
    return rounded(profile.mean_interval(d.base), 6, "mean_value", "standard_error", "ci_low", "ci_high")


@query("a15_standard_error_by_pillar", f"select pillar, count(*) readings, {MEAN} mean_value, round(stddev_samp(measured_value)/sqrt(count(*)),6) standard_error from dashboard_base group by pillar")
def _(d: Domain):
    out = profile.mean_interval(d.base, "pillar").select("pillar", "readings", "mean_value", "standard_error")
    return rounded(out, 6, "standard_error")


@query("a16_date_span", "select min(read_at) first_read, max(read_at) last_read from dashboard_base")
def _(d: Domain):
    return profile.date_span(d.base)


@query("a17_mean_by_month", f"select strftime(read_at,'%Y-%m') \"month\", pillar, {MEAN} mean_value from dashboard_base group by all")
def _(d: Domain):
    return profile.mean_by_month_and_pillar(d.base)


@query("a18_mean_by_category", f"select category, {MEAN} mean_value from dashboard_base group by category")
def _(d: Domain):
    return profile.mean_by(d.base, "category")


# --- pivots and correlation ------------------------------------------------------------------------------

TOP = "select industry from dashboard_base where industry is not null group by industry order by count(*) desc, industry limit"


def case_mean(column: str, value: str, name: str) -> str:
    v = f"case when {column}='{value}' then measured_value end"
    return f"cast(sum(cast({v} as decimal(18,4))) as double)/nullif(count({v}),0) {name}"


PILLAR_MEANS = ", ".join(case_mean("pillar", p, p.lower()) for p in ("ENVIRONMENTAL", "SOCIAL", "GOVERNANCE"))
HEAT = ", ".join(
    f"coalesce({case_mean('metric_name', m, '')},0) {m.lower().replace(' ', '_')}"
    for m in ("Environment score", "Social score", "Governance score", "Total score")
)
WIDE = f"""wide as (select trade_name, {PILLAR_MEANS} from dashboard_base group by trade_name
having count(distinct pillar)=3)"""
PAIRS = " union all ".join(
    f"select '{a}' pillar_a, '{b}' pillar_b, round(corr({a.lower()},{b.lower()}),3) r from wide"
    for a, b in (("ENVIRONMENTAL", "SOCIAL"), ("ENVIRONMENTAL", "GOVERNANCE"), ("SOCIAL", "GOVERNANCE"))
)


@query("a19_sector_metric_means", f"select industry, {HEAT} from dashboard_base where industry in ({TOP} 15) group by industry")
def _(d: Domain):
    return profile.sector_metric_heat(d.base)


@query("a20_company_pillar_means", "select * from wide", WIDE)
def _(d: Domain):
    return profile.pillar_means(d.base, "trade_name")


@query("a21_company_sector_pillar_means", f"select trade_name, industry, {PILLAR_MEANS} from dashboard_base where industry is not null group by all having count(distinct pillar)=3")
def _(d: Domain):
    return profile.pillar_means(d.base, "trade_name", "industry")


@query(
    "a22_correlation_matrix",
    " union all ".join(
        f"select '{a.upper()}' pillar, "
        + ", ".join(f"round(corr({a},{b}),3) {b}" for b in ("environmental", "social", "governance"))
        + " from wide"
        for a in ("environmental", "social", "governance")
    ),
    WIDE,
)
def _(d: Domain):
    return profile.correlation_matrix(d.base)


@query("a23_correlated_pairs", PAIRS, WIDE)
def _(d: Domain):
    return profile.pillar_correlations(d.base)


# --- distributions ---------------------------------------------------------------------------------------


@query("a24_sector_status_counts", f"select industry, status, count(*) readings from dashboard_base where industry in ({TOP} 10) group by all")
def _(d: Domain):
    return profile.top_sector_status(d.base)


@query(
    "a25_histogram",
    """select pillar, cast(least(floor((measured_value-lo)/(hi-lo)*30)+1,30) as int) bin, count(*) readings
from dashboard_base, span group by all""",
    "span as (select min(measured_value) lo, max(measured_value) hi from dashboard_base)",
)
def _(d: Domain):
    return profile.histogram(d.base)


def box_sql(keys: str, where: str) -> tuple[str, str]:
    cte = f"""kept as (select * from dashboard_base where {where}),
q as (select {keys}, quantile_cont(measured_value,0.25) q1, median(measured_value) median,
quantile_cont(measured_value,0.75) q3 from kept group by all),
marked as (select kept.*, q.q1, q.median, q.q3,
measured_value between q1-(q3-q1)*1.5 and q3+(q3-q1)*1.5 inside from kept join q using ({keys}))"""
    sql = f"""select {keys}, round(max(q1),6) q1, round(max(median),6) median, round(max(q3),6) q3,
min(measured_value) filter (inside) whisker_low, max(measured_value) filter (inside) whisker_high,
count(*) filter (not inside) outliers from marked group by all"""
    return sql, cte


@query("a26_box_by_pillar", *box_sql("pillar", "true"))
def _(d: Domain):
    return rounded(profile.box_summary(d.base, "pillar"), 6, *profile.QUARTILES)


@query("a26_outlier_rows", "select reading_id, pillar, measured_value, industry, count(*) copies from marked where not inside group by all", box_sql("pillar", "true")[1])
def _(d: Domain):
    return profile.box_outliers(d.base).select("reading_id", "pillar", V, "industry", "copies")


@query("a27_box_by_sector", *box_sql("industry, pillar", f"industry in ({TOP} 15)"))
def _(d: Domain):
    return rounded(profile.top_sector_boxes(d.base), 6, *profile.QUARTILES)


@query("a28_eligible_sectors", "select industry, count(*) readings from dashboard_base where industry is not null group by industry having count(*)>=5")
def _(d: Domain):
    return profile.eligible_sectors(d.base)


@query("a8_log_by_new_status", """select new_status, count(*) transitions, 100.0::double*count(*)/sum(count(*)) over () "percent"
from (select case when reading_id%3=0 then 'VALIDATED' when reading_id%3=1 then 'REJECTED' else 'PENDING' end new_status, status
from reading) where new_status<>status group by new_status""")
def _(d: Domain):
    new = F.when(F.col("reading_id") % 3 == 0, "VALIDATED").when(F.col("reading_id") % 3 == 1, "REJECTED").otherwise("PENDING")
    change = dml.update_status(d.reading, d.reading.select("reading_id", new.alias("status")))
    return profile.log_by_new_status(dml.log_rows(empty_log(d), change.transitions, "2026-01-01 00:00:00"))


@query("a29_log_summary", "select count(*) transitions, count(distinct reading_id) readings from reading where status='REJECTED' and measured_value>5000")
def _(d: Domain):
    log = dml.log_rows(empty_log(d), dml.reopen_rejected(d.reading).transitions, "2026-01-01 00:00:00")
    return profile.log_summary(log)


@query("a30_scatter_sample", "select reading_id, read_at, measured_value, pillar from reading_overview order by reading_id limit 500")
def _(d: Domain):
    return profile.scatter_sample(d.reading_overview)


@query("a31_empty_selection", "select count(*) readings, cast(null as double) validated_percent from dashboard_base where industry='NO SUCH SECTOR'")
def _(d: Domain):
    return profile.counted(d.base.filter(industries=["NO SUCH SECTOR"]))


@query("a31_filtered_count", f"select count(*) readings, 100.0::double*count(*) filter (status='VALIDATED')/count(*) validated_percent from dashboard_base where {FILTERS}")
def _(d: Domain):
    return profile.counted(
        d.base.filter(
            industries=["BUILDING 1", "FURNITURE 2", "MACHINERY 0"],
            pillars=["SOCIAL", "GOVERNANCE"],
            statuses=["VALIDATED", "PENDING"],
        )
    )


@query(
    "dashboard_summary",
    f"""select count(*) readings, 100.0::double*count(*) filter (status='VALIDATED')/count(*) validated_percent,
count(distinct trade_name) companies, count(distinct industry) industries, {MEAN} mean_value,
round(var_samp(measured_value),4) variance, round(stddev_samp(measured_value),6) sd,
round(avg(pow(measured_value-m,3))/pow(avg(pow(measured_value-m,2)),1.5),6) skewness,
round(kurtosis_pop(measured_value),6) kurtosis, round(median(measured_value),6) median,
(select round_even(measured_value,1) v from dashboard_base group by 1 order by count(*) desc, v limit 1) mode_value
from dashboard_base, stats""",
    OVERALL,
)
def _(d: Domain):
    return rounded(rounded(profile.summary(d.base), 6, "sd", "skewness", "kurtosis", "median"), 4, "variance")


@query(
    "sector_pillar_summary",
    f"""select industry, pillar, count(*) readings, {MEAN} mean_value, round(stddev_samp(measured_value),6) sd,
100.0::double*count(*) filter (status='VALIDATED')/count(*) validated_percent,
count(*) filter (measured_value<=100) low_impact,
count(*) filter (measured_value>100 and measured_value<=500) moderate_impact,
count(*) filter (measured_value>500) critical_impact, round(median(measured_value),6) median
from dashboard_base where industry is not null group by all""",
)
def _(d: Domain):
    return rounded(profile.sector_pillar_summary(d.base), 6, "sd", "median")


# --- scalar functions ------------------------------------------------------------------------------------

IMPACT = """case when measured_value<=100 then 'LOW IMPACT / COMPLIANT' when measured_value<=500
then 'MODERATE IMPACT / ATTENTION' else 'CRITICAL IMPACT / ALERT' end"""


@query("r1_impact_class", f"select reading_id, {IMPACT} impact from reading")
def _(d: Domain):
    return d.reading.select("reading_id", impact_class(V).alias("impact"))


@query("r1_impact_class_sql_function", f"select {IMPACT} impact, count(*) readings from reading group by 1")
def _(d: Domain):
    d.register_views().sql(
        "create or replace temporary function impact_class(x double) returns string return "
        + IMPACT.replace("measured_value", "x")
    )
    return d.spark.sql("select impact_class(measured_value) impact, count(*) readings from reading group by 1")


@query(
    "scalar_functions",
    """select ticker, concat(substr(g,1,2),'.',substr(g,3,3),'.',substr(g,6,3),'/',substr(g,9,4),'-',substr(g,13,2)) tax_id,
case when upper(trim(social_grade)) in ('A','AA','AAA','BBB') then 'VALIDATED' when upper(trim(social_grade))='BB'
then 'PENDING' else 'REJECTED' end status, strftime(dt,'%Y-%m') "month", round_even(total_score/7,1) seventh
from (select *, rpad(translate(sha1(ticker),'abcdef',''),14,'0') g,
coalesce(cast(try_strptime(last_processing_date,'%d-%m-%Y') as date), date '2022-04-19') dt from raw_scores)""",
)
def _(d: Domain):
    day = processing_date("last_processing_date")
    return d.raw_scores.select(
        "ticker",
        pseudo_tax_id("ticker").alias("tax_id"),
        status_from_grade("social_grade").alias("status"),
        month_of(day).alias("month"),
        one_place(F.col("total_score") / 7).alias("seventh"),
    )
