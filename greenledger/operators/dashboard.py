"""The filtered base of all dashboard statistics: facts and company labels, joined as late as possible."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import exact_count, exact_parts, weighed_parts
from ..session import checkpointed
from .moments import sum_and_shape
from .views import metric_pillars

VALUE = "measured_value"
W = "copies"


@dataclass(frozen=True)
class Dashboard:
    """Readings with their metric (``facts``) and, per company id, name, sector and ``copies`` (``labels``).

    The dashboards rejoin companies by name, and names are not unique: a reading meets every company of its
    company's name. Labels are therefore collapsed to one row per id and *distinct* sector of the name, and
    ``copies`` says how many companies stand behind it. A name shared by very many companies thus never
    multiplies the facts. Sum ``copies`` to count.

    Counts and means are combined per company before the join (``totals``), so what is shuffled is one row per
    company and key, and a company with very many readings is one row like any other. Only statistics that
    need the single values join all facts (``values``). ``rows`` is the base with all its columns.
    """

    facts: DataFrame
    labels: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.facts.join(self.labels, "company_id")

    def _labels_by(self, *keys: str) -> DataFrame:
        """Labels with only the keys asked for. Those that agree on them are merged: a statistic that does not
        ask for the sector meets one label per company, however many sectors stand behind its name."""
        wanted = [k for k in keys if k in self.labels.columns]
        return _keyed(self.labels, wanted).groupBy("company_id", *wanted).agg(F.sum(W).cast("bigint").alias(W))

    def values(self, *keys: str) -> DataFrame:
        """Single facts with the label keys asked for, weighted by ``copies``."""
        return self.facts.join(self._labels_by(*keys), "company_id")

    def with_facts(self, **columns: Column) -> Dashboard:
        return replace(self, facts=self.facts.withColumns(columns))

    def where_facts(self, condition: Column | str) -> Dashboard:
        return replace(self, facts=self.facts.where(condition))

    def where_labels(self, condition: Column | str) -> Dashboard:
        return replace(self, labels=self.labels.where(condition))

    def filter(
        self,
        industries: Sequence[str] = (),
        companies: Sequence[str] = (),
        pillars: Sequence[str] = (),
        statuses: Sequence[str] = (),
        first_day: date | None = None,
        last_day: date | None = None,
    ) -> Dashboard:
        """Optional filters; an empty list filters nothing, days are inclusive.

        Days are compared as timestamps, so that the comparison reaches the scan of the readings.
        """
        out = self
        if industries:
            out = out.where_labels(F.col("industry").isin(list(industries)))
        if companies:
            out = out.where_labels(F.col("trade_name").isin(list(companies)))
        if pillars:
            out = out.where_facts(F.col("pillar").isin(list(pillars)))
        if statuses:
            out = out.where_facts(F.col("status").isin(list(statuses)))
        if first_day is not None:
            out = out.where_facts(F.col("read_at") >= F.lit(first_day.isoformat()).cast("timestamp_ntz"))
        if last_day is not None:
            end = (last_day + timedelta(days=1)).isoformat()
            out = out.where_facts(F.col("read_at") < F.lit(end).cast("timestamp_ntz"))
        return out

    def per_company(self, combine: Callable[[DataFrame, list[str]], DataFrame], *keys: str) -> DataFrame:
        """``combine(facts, grouping columns)`` per company and fact key, joined to the labels asked for."""
        fact_keys = [k for k in keys if k in self.facts.columns]
        return combine(_keyed(self.facts, fact_keys), ["company_id", *fact_keys]).join(self._labels_by(*keys), "company_id")

    def counts(self, *keys: str, **more: tuple[Callable, str]) -> DataFrame:
        """Weighted rows (n) per key; NULL keys form no group. ``more`` adds smallest or
        largest values, which no weight changes, as ``name=(F.min, column)``.

        Facts are counted per company and fact key before the join, so no single fact is shuffled to its label.
        """
        fact_keys = [k for k in keys if k in self.facts.columns]
        part = _keyed(self.facts, fact_keys).groupBy("company_id", *fact_keys).agg(
            F.count(F.lit(1)).alias("n"), *[f(c).alias(name) for name, (f, c) in more.items()]
        )
        n = F.sum(F.col("n") * F.col(W)).cast("bigint").alias("n")
        joined = part.join(self._labels_by(*keys), "company_id")
        return joined.groupBy(*keys).agg(n, *[f(name).alias(name) for name, (f, _) in more.items()])

    def totals(self, *keys: str) -> DataFrame:
        """Weighted rows (n), values (c) and both parts of the sum (s, e) per key; NULL keys form no group."""
        near, rest = exact_parts(VALUE)
        fact_keys = [k for k in keys if k in self.facts.columns]
        part = _keyed(self.facts, fact_keys).groupBy("company_id", *fact_keys).agg(
            F.count(F.lit(1)).alias("n"), exact_count(VALUE).alias("c"), near.alias("s"), rest.alias("e")
        )
        return merge_totals(part.join(self._labels_by(*keys), "company_id"), *keys)

    def parts(self, *keys: str) -> DataFrame:
        """Per company and key all that ``merge_totals``, ``merge_moments`` and ``Bins`` merge into their figures, with
        ``copies``, in one pass over the facts. Rows of NULL fact keys stay, so that each figure can leave out its own."""
        fact_keys = [k for k in keys if k in self.facts.columns]
        part = self.facts.groupBy("company_id", *fact_keys).agg(
            F.count(F.lit(1)).alias("n"), exact_count(VALUE).alias("c"), *sum_and_shape(VALUE),
            F.min(VALUE).alias("least"), F.max(VALUE).alias("most"),
        )
        return part.join(self._labels_by(*keys), "company_id")

    def top(self, k: int, key: str = "industry") -> DataFrame:
        """The k most frequent values of a label; equal counts are ordered by value."""
        return most_frequent(self.totals(key), k, key)

    def keep_top(self, k: int, key: str = "industry") -> Dashboard:
        """Only labels among the k most frequent. The list has k rows: it is made once and broadcast to the labels."""
        top = checkpointed(self.top(k, key).select(key))
        return replace(self, labels=self.labels.join(F.broadcast(top), key, "left_semi"))


def merge_totals(parts: DataFrame, *keys: str) -> DataFrame:
    """Totals per key from parts that know their ``copies``."""
    near, rest = weighed_parts(F.col("s"), F.col("e"), W)
    return _keyed(parts, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("n") * F.col(W)), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.sum(F.col("c") * F.col(W)), F.lit(0)).cast("bigint").alias("c"),
        F.sum(near).alias("s"),
        F.sum(rest).alias("e"),
    )


def most_frequent(totals: DataFrame, k: int, key: str = "industry") -> DataFrame:
    """The k values of ``key`` with the largest sum of n."""
    return totals.groupBy(key).agg(F.sum("n").cast("bigint").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def keep_most_frequent(totals: DataFrame, k: int, key: str = "industry") -> DataFrame:
    """Totals of the k most frequent values, found from the totals themselves without another look at the facts."""
    return totals.join(F.broadcast(most_frequent(totals, k, key).select(key)), key, "left_semi")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def build_dashboard(
    reading: DataFrame, company: DataFrame, metric: DataFrame, category: DataFrame, key: str = "trade_name"
) -> Dashboard:
    """``key="company_id"`` takes each company's own sector instead of those of its name."""
    own = company.select("company_id", "trade_name", "tax_id", "industry")
    if key == "company_id":
        labels = own.withColumn(W, F.lit(1).cast("bigint"))
    else:
        sectors = company.groupBy("trade_name", "industry").agg(F.count(F.lit(1)).alias(W))
        labels = own.drop("industry").join(sectors, "trade_name")
    dims = metric_pillars(metric, category).select("metric_id", F.col("name").alias("metric_name"), "category", "pillar")
    facts = reading.join(dims, "metric_id").select(
        "reading_id", "company_id", "read_at", VALUE, "status", "metric_name", "category", "pillar"
    )
    return Dashboard(facts, labels)

