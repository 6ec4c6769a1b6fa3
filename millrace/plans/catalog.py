"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from millrace.plans import neardup, reports, series, texts

MODULES = (reports, texts, neardup, series)


def queries() -> dict:
    """Name to ``(spark, folder) -> DataFrame``."""
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to the SQL of the same result."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
