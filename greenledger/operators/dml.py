"""Inserts, updates and deletes as functions from one snapshot to the next.

Each returns a ``Change``: the new snapshot (lazy), the rows it touches, and the status transitions it causes.
Snapshot and log are written by the caller (``sources.tables``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import blank_keeps
from ..schema import STATUSES, TABLES, Table
from .ordering import dense_ids
from .rules import duplicate_keys, outside_domain, rule_report

CHANGED_BY = "greenledger"
VALUE_LIMIT = 5000.0


class RuleViolation(ValueError):
    """A statement broke a rule; nothing of it is applied."""


@dataclass(frozen=True)
class Change:
    snapshot: DataFrame
    touched: DataFrame
    transitions: DataFrame | None = None

    def affected(self) -> DataFrame:
        """Number of rows the statement touched."""
        return self.touched.agg(F.count(F.lit(1)).alias("affected"))

    def last_id(self, key: str) -> DataFrame:
        """The largest key among the rows the statement touched: after an insert, the id given last."""
        return self.touched.agg(F.max(key).alias("last_id"))


# --- inserts ---------------------------------------------------------------------------------------------


def with_next_ids(existing: DataFrame, new: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Continue the numbering of ``existing`` over the new rows. Only the new rows are ordered."""
    last = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint")).scalar()
    numbered = dense_ids(new, order, "_n")
    return numbered.withColumn(id_column, F.col("_n") + last).drop("_n")


def check_insert(new: DataFrame, table: Table, tables: Mapping[str, DataFrame]) -> None:
    """Refuse the whole batch when any row breaks a rule. The report has a handful of rows."""
    report = rule_report(new, table, tables, existing=tables[table.name])
    broken = report.where(F.col("violations") > 0).orderBy("rule", "columns").collect()
    if broken:
        raise RuleViolation("; ".join(f"{r.rule} ({r.columns}): {r.violations}" for r in broken))


def insert(name: str, new: DataFrame, tables: Mapping[str, DataFrame], check: bool = True) -> Change:
    """Add rows to a table after checking its rules. ``check=False`` leaves the report to the caller."""
    table = TABLES[name]
    rows = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    if check:
        check_insert(rows, table, tables)
    return Change(tables[name].unionByName(rows), rows)


def company_batch(existing: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """New companies with ids; parent 0 means no parent."""
    return with_next_ids(existing, new, "company_id", order).withColumn(
        "parent_company_id", F.nullif("parent_company_id", F.lit(0))
    )


def metric_batch(existing: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    return with_next_ids(existing, new, "metric_id", order)


def reading_batch(existing: DataFrame, new: DataFrame, order: Sequence[str], day: str = "day", hour: int = 9) -> DataFrame:
    """New readings with ids, taken at nine o'clock of their day."""
    at = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(hour), F.lit(0), F.lit(0))
    return with_next_ids(existing, new, "reading_id", order).withColumn("read_at", at)


# --- updates and deletes ---------------------------------------------------------------------------------


def update_companies(company: DataFrame, changes: DataFrame) -> Change:
    """Partial update by id: a NULL or blank name or city keeps the old one.

    ``changes`` has company_id, trade_name and city, one row per id.
    """
    new = changes.select("company_id", F.col("trade_name").alias("_name"), F.col("city").alias("_city"))
    snapshot = (
        company.join(new, "company_id", "left")
        .withColumn("trade_name", blank_keeps("_name", "trade_name"))
        .withColumn("city", blank_keeps("_city", "city"))
        .select(*company.columns)
    )
    return Change(snapshot, company.join(changes.select("company_id"), "company_id", "left_semi"))


def referenced_keys(ids: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Those of ``ids`` that some child table still refers to."""
    used = None
    for child, column in children:
        part = child.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
        used = part if used is None else used.unionByName(part)
    return ids.select(key).join(used, key, "left_semi")


def delete_unreferenced(
    parent: DataFrame, ids: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]]
) -> Change:
    """Delete by id where no child refers to the row; referenced rows stay."""
    gone = ids.select(key).distinct()
    gone = gone.join(referenced_keys(gone, key, children), key, "left_anti")
    return Change(parent.join(gone, key, "left_anti"), parent.join(gone, key, "left_semi"))


def transition_rows(before: DataFrame, new_status: Column, where: Column) -> DataFrame:
    """Real status changes a conditional update causes, read off the old rows alone."""
    return (
        before.where(where)
        .select("reading_id", F.col("status").alias("old_status"), new_status.alias("new_status"))
        .where(F.col("old_status") != F.col("new_status"))
    )


def status_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Real status changes between any two snapshots of the readings; NULL is no change."""
    after = new.select("reading_id", F.col("status").alias("new_status"))
    return (
        old.select("reading_id", F.col("status").alias("old_status"))
        .join(after, "reading_id")
        .where(F.col("old_status") != F.col("new_status"))
    )


def update_status(reading: DataFrame, changes: DataFrame, check: bool = True) -> Change:
    """Set the status by id. ``changes`` has reading_id and status, one row per id."""
    if check:
        if not outside_domain(changes, "status", STATUSES).isEmpty():
            raise RuleViolation("check (status)")
        if not duplicate_keys(changes, ["reading_id"]).isEmpty():
            raise RuleViolation("one change per reading")
    new = changes.select("reading_id", F.col("status").alias("_status"))
    joined = reading.join(new, "reading_id", "left")
    snapshot = joined.withColumn("status", F.coalesce("_status", "status")).select(*reading.columns)
    touched = reading.join(new.select("reading_id"), "reading_id", "left_semi")
    return Change(snapshot, touched, transition_rows(joined, F.col("_status"), F.col("_status").isNotNull()))


def _conditional(reading: DataFrame, where: Column, status: str, **columns: Column) -> Change:
    """One projection over the readings: no shuffle, no join, no loop over rows."""
    hit = F.coalesce(where, F.lit(False))
    snapshot = reading
    for name, value in {"status": F.lit(status), **columns}.items():
        snapshot = snapshot.withColumn(f"_{name}", F.when(hit, value).otherwise(F.col(name)))
    snapshot = snapshot.select(
        *[F.col(f"_{c}").alias(c) if c in ("status", *columns) else F.col(c) for c in reading.columns]
    )
    return Change(snapshot, reading.where(hit), transition_rows(reading, F.lit(status), hit))


def settle_site(reading: DataFrame, site_id: int, company_id: int, status: str) -> Change:
    """Give all pending readings of one site a new status."""
    if status not in STATUSES:
        raise RuleViolation("check (status)")
    where = (
        (F.col("site_id") == site_id) & (F.col("company_id") == company_id) & (F.col("status") == "PENDING")
    )
    return _conditional(reading, where, status)


def reopen_rejected(reading: DataFrame, limit: float = VALUE_LIMIT) -> Change:
    """Rejected readings above the technical limit go back to pending with the value 0."""
    where = (F.col("status") == "REJECTED") & (F.col("measured_value") > limit)
    return _conditional(reading, where, "PENDING", measured_value=F.lit(0.0))


# --- change log ------------------------------------------------------------------------------------------


def log_rows(log: DataFrame, transitions: DataFrame, changed_at: str, changed_by: str = CHANGED_BY) -> DataFrame:
    """Transitions as new rows of the status log; the time is one literal per statement."""
    rows = with_next_ids(log, transitions, "log_id", ["reading_id"])
    rows = rows.withColumn("changed_at", F.lit(changed_at).cast("timestamp_ntz")).withColumn("changed_by", F.lit(changed_by))
    return rows.select(*TABLES["status_log"].schema.fieldNames())


def log_newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("log_id"))
