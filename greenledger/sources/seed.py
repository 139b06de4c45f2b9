"""Fixed dimension rows a new store starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TABLES

# Fixed values.
CATEGORIES = (
    (1, "Environment", "ENVIRONMENTAL"),
    (2, "Society", "SOCIAL"),
    (3, "Corporate governance", "GOVERNANCE"),
)
METRICS = (
    (1, "Environment score", "range 0-1000", 1),
    (2, "Social score", "range 0-1000", 2),
    (3, "Governance score", "range 0-1000", 3),
    (4, "Total score", "range 0-3000", 3),
)
AUDITORS = (
    ("111.222.333-44", "Carla Mendes", "CRC-SP 12345"),
    ("222.333.444-55", "Joao Lima", "CRC-RJ 23456"),
    ("333.444.555-66", "Beatriz Souza", "CRC-MG 34567"),
    ("444.555.666-77", "Eduardo Reis", "CRC-PR 45678"),
    ("555.666.777-88", "Helena Castro", "CRC-SC 56789"),
)


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Each as one expression over literals, so no Python worker is needed to make them."""
    out = {}
    for name, rows in {"category": CATEGORIES, "metric": METRICS, "auditor": AUDITORS}.items():
        fields = TABLES[name].schema.fields
        literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, r)]) for r in rows]
        out[name] = spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))
    return out
