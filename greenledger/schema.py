"""Tables of the model: Spark schemas and the rules that Spark itself does not enforce."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PILLARS = ("ENVIRONMENTAL", "SOCIAL", "GOVERNANCE")
STATUSES = ("PENDING", "VALIDATED", "REJECTED")
# Metric id, score column, grade column of the wide score file (fixed values).
SCORE_METRICS = (
    (1, "environment_score", "environment_grade"),
    (2, "social_score", "social_grade"),
    (3, "governance_score", "governance_grade"),
    (4, "total_score", "total_grade"),
)
METRIC_NAMES = ("Environment score", "Social score", "Governance score", "Total score")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    non_negative: tuple[str, ...] = ()


_KINDS = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema from "name kind, name kind"; needs no session, so it can stand at module level."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


TABLES = {
    t.name: t
    for t in (
        Table(
            "company",
            _struct(
                "company_id bigint, trade_name string, tax_id string, city string, industry string,"
                " parent_company_id bigint"
            ),
            primary_key=("company_id",),
            unique=(("tax_id",),),
            not_null=("trade_name", "tax_id"),
            foreign_keys=(ForeignKey(("parent_company_id",), "company", ("company_id",)),),
        ),
        Table(
            "site",
            _struct("site_id int, company_id bigint, site_name string, location string"),
            primary_key=("site_id", "company_id"),
            not_null=("site_id", "company_id", "site_name"),
            foreign_keys=(ForeignKey(("company_id",), "company", ("company_id",)),),
        ),
        Table(
            "category",
            _struct("category_id int, description string, pillar string"),
            primary_key=("category_id",),
            not_null=("description", "pillar"),
            domains={"pillar": PILLARS},
        ),
        Table(
            "metric",
            _struct("metric_id int, name string, description string, category_id int"),
            primary_key=("metric_id",),
            not_null=("name", "category_id"),
            foreign_keys=(ForeignKey(("category_id",), "category", ("category_id",)),),
        ),
        Table(
            "reading",
            _struct(
                "reading_id bigint, read_at timestamp_ntz, measured_value double, status string,"
                " site_id int, company_id bigint, metric_id int"
            ),
            primary_key=("reading_id",),
            not_null=("read_at", "measured_value", "status", "site_id", "company_id", "metric_id"),
            domains={"status": STATUSES},
            foreign_keys=(
                ForeignKey(("site_id", "company_id"), "site", ("site_id", "company_id")),
                ForeignKey(("metric_id",), "metric", ("metric_id",)),
            ),
            non_negative=("measured_value",),
        ),
        Table(
            "auditor",
            _struct("auditor_id string, name string, license_no string"),
            primary_key=("auditor_id",),
            not_null=("name",),
        ),
        Table(
            "audit",
            _struct("audit_id bigint, audit_date date, final_opinion string, auditor_id string"),
            primary_key=("audit_id",),
            not_null=("audit_date", "auditor_id"),
            foreign_keys=(ForeignKey(("auditor_id",), "auditor", ("auditor_id",)),),
        ),
        Table(
            "audit_reading",
            _struct("audit_id bigint, reading_id bigint"),
            primary_key=("audit_id", "reading_id"),
            not_null=("audit_id", "reading_id"),
            foreign_keys=(
                ForeignKey(("audit_id",), "audit", ("audit_id",)),
                ForeignKey(("reading_id",), "reading", ("reading_id",)),
            ),
        ),
        Table(
            "status_log",
            _struct(
                "log_id bigint, reading_id bigint, old_status string, new_status string,"
                " changed_at timestamp_ntz, changed_by string"
            ),
            primary_key=("log_id",),
        ),
    )
}

# Where a row of a file stood: file, start of the split, and running number in the order the split was read.
POSITION = T.StructType([T.StructField("file", T.StringType()), *_struct("start bigint, line bigint").fields])

# The wide score file, one row per listed company, in the order of ``row_no``.
FILE_ORDER = "row_no"
_SCORE_COLUMNS = _struct(
    "ticker string, name string, exchange string, industry string, last_processing_date string,"
    " environment_score double, social_score double, governance_score double, total_score double,"
    " environment_grade string, social_grade string, governance_grade string, total_grade string"
)
SCORE_FILE = T.StructType([T.StructField(FILE_ORDER, POSITION), *_SCORE_COLUMNS.fields])
