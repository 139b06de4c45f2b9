"""Distinct companies from mergeable sketches, kept per month and dashboard key and united under the filters.

A distinct count of a year is not the sum of its months, so exact counts go back to the facts for every filter. Sketches of
fixed size can be united instead: they are made once, written as a table, and any choice of months, pillars, statuses and
sectors reads that table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import month_of
from .dashboard import Dashboard

KEYS = ("month", "pillar", "status", "industry")
#: 2^12 registers: one standard error is 1.6 % of the count.
REGISTERS = 12


def company_sketches(base: Dashboard, registers: int = REGISTERS) -> DataFrame:
    """``KEYS`` and a sketch of the names of the companies with readings there. NULL keys form rows of their own; NULL
    names are not counted.

    Readings are reduced to one row per company and key before they meet the labels, and each task combines its own
    sketches, so a company or sector with very many readings sends one row a task.
    """
    fact_keys = [k for k in KEYS if k != "industry"]
    facts = base.facts.select("company_id", month_of("read_at").alias("month"), "pillar", "status").distinct()
    labels = base.labels.select("company_id", "trade_name", "industry").distinct()
    sketch = F.hll_sketch_agg("trade_name", F.lit(registers)).alias("companies")
    return facts.join(labels, "company_id").groupBy(*fact_keys, "industry").agg(sketch)


def distinct_companies(sketches: DataFrame, *by: str, where: Column | None = None) -> DataFrame:
    """Estimated number of companies per ``by`` among the sketches that meet ``where``; NULL keys form no group.

    Without ``by`` there is one row, of 0 where no sketch is left.
    """
    kept = sketches if where is None else sketches.where(where)
    kept = kept.dropna(subset=list(by)) if by else kept
    estimate = F.hll_sketch_estimate(F.hll_union_agg("companies"))
    return kept.groupBy(*by).agg(F.coalesce(estimate, F.lit(0)).cast("bigint").alias("companies"))
