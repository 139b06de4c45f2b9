"""All registered queries; importing a module of queries registers them."""

from __future__ import annotations

from importlib import import_module

from .registry import callables, oracles

MODULES = ("relational", "statistics", "ingest", "changes", "inference", "models", "streams")

for _name in MODULES:
    import_module(f"{__package__}.{_name}")

__all__ = ["callables", "oracles"]
