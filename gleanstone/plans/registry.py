"""All queries of the core and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

from gleanstone.plans.base import QUERIES, SQL

for _m in ("evidence", "windows", "joins", "aggregates", "ordering", "scalars", "checker", "report", "statistics", "models", "sampling", "scans", "geometry", "service"):
    import_module(f"gleanstone.plans.{_m}")

__all__ = ["QUERIES", "SQL"]
