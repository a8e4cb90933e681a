"""All queries outside the llm subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import artifacts, checks, clips, evaluation, folding, gates, graphs, manifests, registry, relations, reports, scans, statistics, windowing, windows  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
