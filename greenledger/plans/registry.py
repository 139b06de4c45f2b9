"""Registered queries: name, Spark function over a Domain, SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, domain_of, with_domain


@dataclass(frozen=True)
class Entry:
    run: Callable[[Domain], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, ctes: str = "") -> Callable:
    """Register a function of a Domain under ``name``; ``oracle`` may use every domain relation."""

    def add(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(fn, with_domain(oracle, ctes) if oracle else None)
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(domain_of(spark, sf_dir))

    return {name: bind(e.run) for name, e in ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: e.oracle for name, e in ENTRIES.items() if e.oracle}
