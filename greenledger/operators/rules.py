"""Keys, references and value rules as jobs. Each function returns what breaks the rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TABLES, ForeignKey, Table


def _all_set(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; a key with a NULL part is not compared."""
    return (
        df.where(_all_set(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of NULLs per column, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not allowed; NULL passes, as in a CHECK."""
    return df.where(~F.col(column).isin(list(allowed)))


def orphans(df: DataFrame, key: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows whose reference finds no parent; a reference with a NULL part is not checked."""
    names = dict(zip(key.parent_columns, key.columns))
    keys = parent.select(*[F.col(p).alias(c) for p, c in names.items()]).distinct()
    return df.where(_all_set(key.columns)).join(keys, list(key.columns), "left_anti")


def negative_values(df: DataFrame, column: str = "measured_value") -> DataFrame:
    return df.where(F.col(column) < 0)


def _count(df: DataFrame, table: str, rule: str, on: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(",".join(on)).alias("columns"), "violations"
    )


def rule_report(df: DataFrame, table: Table, tables: Mapping[str, DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """Violations per rule of a table, one row each.

    With ``existing`` only ``df`` is checked, as rows about to be added to ``existing``.
    """
    parts = []
    for rule, keys in (("primary key", [table.primary_key]), ("unique", table.unique)):
        for key in keys:
            parts.append(_count(duplicate_keys(df, key), table.name, rule, key))
            if existing is not None:
                clash = df.join(existing.select(*key), list(key), "left_semi")
                parts.append(_count(clash, table.name, rule, key))
    # Rules that a row breaks on its own are counted together, in one pass.
    alone = [("not null", c, F.col(c).isNull()) for c in dict.fromkeys(table.not_null)]
    alone += [("check", c, ~F.col(c).isin(list(allowed))) for c, allowed in table.domains.items()]
    if existing is not None:
        alone += [("insert guard", c, F.col(c) < 0) for c in table.non_negative]
    if alone:
        counts = F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("columns"), F.count_if(broken).alias("violations"))
            for rule, c, broken in alone
        ])
        parts.append(df.agg(counts.alias("all")).select(F.lit(table.name).alias("table_name"), F.inline("all")))
    for key in table.foreign_keys:
        parent = tables[key.parent]
        if key.parent == table.name and existing is not None:
            parent = parent.unionByName(df, allowMissingColumns=True)
        parts.append(_count(orphans(df, key, parent), table.name, "foreign key", key.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("table_name", "rule", "columns").agg(F.sum("violations").alias("violations"))


def model_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rule report of every given table."""
    reports = [rule_report(df, TABLES[name], tables) for name, df in tables.items()]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def strict_batches(df: DataFrame, table: Table, batch: str) -> DataFrame:
    """What a strict guard does with each batch of ``df``: one row that breaks a row rule refuses all of its batch.

    ``accepted`` is the batch's rows or 0; ``broken`` counts the rows that break a rule.
    """
    reasons = _reasons(table)
    bad = F.concat_ws("; ", *reasons) != ""
    counts = df.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("broken"))
    return counts.withColumn("accepted", F.when(F.col("broken") == 0, F.col("rows")).otherwise(0))


def _reasons(table: Table) -> list[Column]:
    out = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in table.not_null]
    out += [F.when(~F.col(c).isin(list(a)), F.lit(f"{c} not allowed")) for c, a in table.domains.items()]
    return out + [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in table.non_negative]


def split_by_rules(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows by the rules a row can be judged on alone; rejected rows say why."""
    why = F.concat_ws("; ", *_reasons(table))
    marked = df.withColumn("reason", why)
    return marked.where(F.col("reason") == "").drop("reason"), marked.where(F.col("reason") != "")
