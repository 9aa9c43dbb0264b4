"""Every query of the core by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import problems, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return reference.SQL | problems.oracle_sql()
