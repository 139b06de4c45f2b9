"""From the wide score file to the normalised tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import processing_date, pseudo_tax_id, status_from_grade
from ..schema import SCORE_METRICS
from ..session import checkpointed
from .ordering import dense_ids

SEED = 42


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row of each key; ``order`` must be unique.

    Two phases: the smallest position per key, by hash aggregation of two narrow columns, and then the rows that stand
    there. A key with very many copies is one row a task in the first and one row in the second.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, df[key].eqNullSafe(first["_key"]) & (df[order] == first["_first"]), "left_semi")


def listed_companies(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per ticker, numbered in file order, with its processing date."""
    unique = first_per_key(raw, "ticker", order)
    return dense_ids(unique, [order], "company_id").withColumn("day", processing_date("last_processing_date"))


def company_rows(listed: DataFrame) -> DataFrame:
    return listed.select(
        "company_id",
        F.col("name").alias("trade_name"),
        pseudo_tax_id("ticker").alias("tax_id"),
        F.col("exchange").alias("city"),
        "industry",
        F.lit(None).cast("bigint").alias("parent_company_id"),
    )


def site_rows(listed: DataFrame) -> DataFrame:
    return listed.select(
        F.lit(1).alias("site_id"),
        "company_id",
        F.concat(F.lit("HQ "), F.upper("ticker")).alias("site_name"),
        F.col("exchange").alias("location"),
    )


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "metric", value)


def score_and_grade(listed: DataFrame, ids: Sequence[str] = ("company_id", "day")) -> DataFrame:
    """Long form with score and grade side by side: one generator, no join of two long tables."""
    rows = ", ".join(f"'{s}', {m}, {s}, {g}" for m, s, g in SCORE_METRICS)
    return listed.select(*ids, F.expr(f"stack({len(SCORE_METRICS)}, {rows}) as (metric, metric_id, score, grade)"))


def joined_score_and_grade(listed: DataFrame) -> DataFrame:
    """The same long form by two unpivots and an equi-join, kept for callers that have them apart."""
    scores = unpivot(listed, ["company_id", "day"], [s for _, s, _ in SCORE_METRICS], "score")
    grades = unpivot(listed, ["company_id"], [g for _, _, g in SCORE_METRICS], "grade")
    grades = grades.withColumn("metric", F.replace("metric", F.lit("_grade"), F.lit("_score")))
    return scores.join(grades, ["company_id", "metric"])


def metric_number(metric: Column | str) -> Column:
    pairs = [F.lit(x) for m, s, _ in SCORE_METRICS for x in (s, m)]
    return F.element_at(F.create_map(*pairs), F.col(metric) if isinstance(metric, str) else metric)


def reading_rows(listed: DataFrame) -> DataFrame:
    """Four readings per company, numbered metric by metric and company by company."""
    total = listed.agg(F.count(F.lit(1))).scalar()
    return score_and_grade(listed).select(
        ((F.col("metric_id") - 1) * total + F.col("company_id")).cast("bigint").alias("reading_id"),
        F.col("day").cast("timestamp_ntz").alias("read_at"),
        F.col("score").alias("measured_value"),
        status_from_grade("grade").alias("status"),
        F.lit(1).alias("site_id"),
        "company_id",
        F.col("metric_id").cast("int").alias("metric_id"),
    )


def hash_pick(df: DataFrame, key: str, choices: DataFrame, choice: str, seed: int = SEED) -> DataFrame:
    """A seeded, even choice per row that depends on its key alone. ``choices`` is a dimension table."""
    ranked = dense_ids(choices.select(choice), [choice], "_pick", start=0)
    n = choices.agg(F.count(F.lit(1))).scalar()
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn("_pick", F.pmod(draw.cast("bigint"), n)).join(ranked, "_pick").drop("_pick")


def sampled_audits(listed: DataFrame, auditor: DataFrame, every: int = 6, seed: int = SEED) -> DataFrame:
    """An audit for every sixth company, thirty days after its date."""
    picked = listed.where((F.col("company_id") - 1) % every == 0).select(
        F.expr(f"(company_id - 1) div {every} + 1").alias("audit_id"),
        F.date_add("day", 30).alias("audit_date"),
        F.concat(F.lit("ESG audit "), "name").alias("final_opinion"),
        "company_id",
    )
    return hash_pick(picked, "audit_id", auditor, "auditor_id", seed)


def audit_links(audits: DataFrame, reading: DataFrame, metrics: Sequence[int] = (1, 2)) -> DataFrame:
    """Each sampled audit with its company's readings of the given metrics."""
    wanted = reading.where(F.col("metric_id").isin(*metrics)).select("reading_id", "company_id")
    return wanted.join(audits.select("audit_id", "company_id"), "company_id").select("audit_id", "reading_id")


def model_tables(raw: DataFrame, auditor: DataFrame, order: str = "row_no") -> dict[str, DataFrame]:
    """All fact tables of one score file. The numbered companies feed every table, so they are materialised once."""
    listed = checkpointed(listed_companies(raw, order))
    reading = reading_rows(listed)
    audits = sampled_audits(listed, auditor)
    return {
        "company": company_rows(listed),
        "site": site_rows(listed),
        "reading": reading,
        "audit": audits.select("audit_id", "audit_date", "final_opinion", "auditor_id"),
        "audit_reading": audit_links(audits, reading),
    }
