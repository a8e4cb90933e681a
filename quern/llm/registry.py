"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import entries, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(entries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
