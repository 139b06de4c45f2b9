"""Named joins: the two views, the dashboard base and the eight relational questions.

No join carries a hint. The planner broadcasts a side when its known size is under
``spark.sql.autoBroadcastJoinThreshold`` (the fixed dimensions are), AQE does so for sides measured at run
time and splits skewed partitions of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import exact_count, exact_parts, whole_sum
from .topk import newest_joined

NEWEST = (F.desc, "read_at"), (F.asc, "reading_id")


def newest_first() -> list[Column]:
    return [how(name) for how, name in NEWEST]


def metric_pillars(metric: DataFrame, category: DataFrame) -> DataFrame:
    return metric.join(category.select("category_id", F.col("description").alias("category"), "pillar"), "category_id")


def reading_overview(reading: DataFrame, company: DataFrame, metric: DataFrame, category: DataFrame) -> DataFrame:
    """One row per reading with its company, metric, category and pillar."""
    dims = metric_pillars(metric, category).select("metric_id", F.col("name").alias("metric_name"), "category", "pillar")
    names = company.select("company_id", "trade_name", "tax_id")
    return (
        reading.join(dims, "metric_id")
        .join(names, "company_id")
        .select(
            "reading_id", "read_at", "measured_value", "status", "trade_name", "tax_id", "metric_name", "category",
            "pillar",
        )
    )


def audit_detail(audit: DataFrame, auditor: DataFrame, audit_reading: DataFrame, reading: DataFrame) -> DataFrame:
    """Every audit with its auditor and readings; audits without either are kept."""
    people = auditor.select("auditor_id", F.col("name").alias("auditor_name"), "license_no")
    values = reading.select("reading_id", "measured_value", "status")
    # The bridge and the readings meet on the reading's unique key first: the hash of that key spreads an
    # audit with very many readings, and no reading is carried that no audit names.
    links = audit_reading.join(values.withColumnRenamed("reading_id", "_id"), F.col("reading_id") == F.col("_id"), "left")
    links = links.select("audit_id", F.col("_id").alias("reading_id"), "measured_value", "status")
    heads = audit.join(people, "auditor_id", "left")
    columns = [
        "audit_id", "audit_date", "final_opinion", "auditor_name", "license_no", "reading_id", "measured_value", "status",
    ]
    # An inner join can be split on both sides where one audit holds most links; the audits without links follow
    # from an anti join with the distinct ids.
    linked = links.join(heads, "audit_id").select(*columns)
    bare = heads.join(audit_reading.select("audit_id").distinct(), "audit_id", "left_anti")
    kinds = {f.name: f.dataType for f in linked.schema.fields}
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in ("reading_id", "measured_value", "status")]
    return linked.unionByName(bare.select(*columns[:5], *empty))


# --- the eight questions ---------------------------------------------------------------------------------


def newest_readings(
    reading: DataFrame, company: DataFrame, metric: DataFrame, category: DataFrame, limit: int | None = 200
) -> DataFrame:
    """Readings with company, metric and pillar, newest first; ``limit=None`` returns all."""
    dims = metric_pillars(metric, category).select("metric_id", F.col("name").alias("metric_name"), "pillar")
    names = company.select("company_id", "trade_name")

    def join_dimensions(rows: DataFrame) -> DataFrame:
        return (
            rows.join(dims, "metric_id")
            .join(names, "company_id")
            .select("reading_id", "read_at", "measured_value", "status", "trade_name", "metric_name", "pillar")
        )

    rows = reading.select("reading_id", "read_at", "measured_value", "status", "company_id", "metric_id")
    if limit is None:
        return join_dimensions(rows).orderBy(*newest_first())
    return newest_joined(rows, newest_first(), limit, join_dimensions)


def mean_by_pillar(reading: DataFrame, metric: DataFrame, category: DataFrame) -> DataFrame:
    """Count and mean per pillar. Facts are combined per metric before they meet a dimension."""
    near, rest = exact_parts("measured_value")
    per_metric = reading.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("n"),
        exact_count("measured_value").alias("n_values"),
        near.alias("s"),
        rest.alias("e"),
    )
    dims = metric_pillars(metric, category).select("metric_id", "pillar")
    return (
        per_metric.join(dims, "metric_id")
        .groupBy("pillar")
        .agg(
            F.sum("n").alias("total"),
            F.try_divide(whole_sum(F.sum("s"), F.sum("e")), F.sum("n_values").cast("double")).alias("mean_value"),
        )
    )


def count_status_by_company(
    reading: DataFrame, company: DataFrame, status: str = "PENDING", limit: int | None = 20
) -> DataFrame:
    """Readings of one status per company name, most first."""
    per_id = reading.where(F.col("status") == status).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    out = (
        per_id.join(company.select("company_id", "trade_name"), "company_id")
        .groupBy("trade_name")
        .agg(F.sum("n").alias("readings"))
        .orderBy(F.desc("readings"), F.asc("trade_name"))
    )
    return out if limit is None else out.limit(limit)


def audits_by_auditor(auditor: DataFrame, audit: DataFrame) -> DataFrame:
    """Audits per auditor name; auditors without audits count 0."""
    per_auditor = audit.groupBy("auditor_id").agg(F.count("audit_id").alias("n"))
    return (
        auditor.select("auditor_id", "name")
        .join(per_auditor, "auditor_id", "left")
        .groupBy("name")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("audits"))
        .orderBy(F.desc("audits"), F.asc("name"))
    )


def companies_without_site(company: DataFrame, site: DataFrame) -> DataFrame:
    with_site = site.select("company_id").distinct()
    return company.join(with_site, "company_id", "left_anti").select("company_id", "trade_name", "tax_id")


def reconcile_auditors(auditor: DataFrame, audit: DataFrame) -> DataFrame:
    """Full outer match of auditors and audits, without duplicates.

    Written as audits with their auditor plus the auditors no audit names: a full outer join cannot be split
    where one auditor holds a large part of the audits, these two joins can.
    """
    people = auditor.select("auditor_id", F.col("name").alias("auditor_name"))
    named = (
        audit.select(F.col("auditor_id").alias("_ref"), "audit_id", "audit_date")
        .join(people, F.col("_ref") == F.col("auditor_id"), "left")
        .select("auditor_name", "auditor_id", "audit_id", "audit_date")
    )
    used = audit.select("auditor_id").distinct()
    idle = people.join(used, "auditor_id", "left_anti").select(
        "auditor_name",
        "auditor_id",
        F.lit(None).cast(audit.schema["audit_id"].dataType).alias("audit_id"),
        F.lit(None).cast(audit.schema["audit_date"].dataType).alias("audit_date"),
    )
    return named.unionByName(idle).distinct()


def audited_metrics(
    metric: DataFrame, reading: DataFrame, audit_reading: DataFrame, status: str = "VALIDATED"
) -> DataFrame:
    """Metrics with at least one audited reading of the given status."""
    audited = audit_reading.select("reading_id").distinct()
    used = (
        reading.where(F.col("status") == status)
        .select("reading_id", "metric_id")
        .join(audited, "reading_id", "left_semi")
        .select("metric_id")
        .distinct()
    )
    return metric.join(used, "metric_id", "left_semi").select("metric_id", "name", "description")


def above_average_companies(reading: DataFrame, company: DataFrame, limit: int | None = 25) -> DataFrame:
    """Companies whose mean value is above the mean of all readings."""
    near, rest = exact_parts("measured_value")
    sums = reading.groupBy("company_id").agg(near.alias("s"), rest.alias("e"), exact_count("measured_value").alias("c"))
    # The overall mean comes from the sums per company, so the readings are scanned once.
    overall = sums.agg(F.try_divide(whole_sum(F.sum("s"), F.sum("e")), F.sum("c").cast("double")))
    means = sums.withColumn("mean_value", F.try_divide(whole_sum(F.col("s"), F.col("e")), F.col("c").cast("double")))
    out = (
        means.where(F.col("mean_value") > overall.scalar())
        .join(company.select("company_id", "trade_name"), "company_id")
        .select("company_id", "trade_name", "mean_value")
        .orderBy(F.desc("mean_value"), F.asc("company_id"))
    )
    return out if limit is None else out.limit(limit)


# --- lists and look-ups ----------------------------------------------------------------------------------


def table_sizes(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables in one row."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(*[df.agg(F.count(F.lit(1))).scalar().alias(n) for n, df in tables.items()])


def metric_category(rows: DataFrame, metric: DataFrame, category: DataFrame) -> DataFrame:
    """Category description of each row's metric, with a default for unknown metrics."""
    names = metric_pillars(metric, category).select("metric_id", F.col("category").alias("_found"))
    return (
        rows.join(names, "metric_id", "left")
        .withColumn("category", F.coalesce("_found", F.lit("Category not found")))
        .drop("_found")
    )


def sites_with_company(site: DataFrame, company: DataFrame) -> DataFrame:
    return site.join(company.select("company_id", "trade_name"), "company_id").select(
        "site_id", "company_id", "trade_name", "site_name", "location"
    )


def reading_list(
    reading: DataFrame, company: DataFrame, site: DataFrame, metric: DataFrame, limit: int | None = 200
) -> DataFrame:
    """Readings with company, site and metric names; site is matched on its composite key."""
    sites = site.select("site_id", "company_id", "site_name")
    names = company.select("company_id", "trade_name")
    metrics = metric.select("metric_id", F.col("name").alias("metric_name"))

    def join_dimensions(rows: DataFrame) -> DataFrame:
        return (
            rows.join(metrics, "metric_id")
            .join(names, "company_id")
            .join(sites, ["site_id", "company_id"])
            .select("reading_id", "read_at", "measured_value", "status", "trade_name", "site_name", "metric_name")
        )

    if limit is None:
        return join_dimensions(reading).orderBy(*newest_first())
    return newest_joined(reading, newest_first(), limit, join_dimensions)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values, as a filter list offers them."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
