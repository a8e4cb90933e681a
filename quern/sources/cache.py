"""Frames of episodes kept in buckets, so that windows meet them where they lie."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.fitted import name_of


def table_name(prefix: str, fingerprint: str, settings: dict | None = None) -> str:
    return f"{prefix}_{name_of(fingerprint, settings or {})[:20]}"


def cached_frames(
    spark: SparkSession, prefix: str, folder: str, fingerprint: str, keys: list[str], build: Callable[[], DataFrame], *, buckets: int = 200, settings: dict | None = None
) -> DataFrame:
    """The table of a split's frames (keys, idx, ...), in buckets by keys and ``idx`` and sorted in each; built if the catalog doesn't have it.

    A join on keys and ``idx`` needs no exchange of the frames, and an episode
    of any size is dealt to all buckets. The table's name is told by the
    fingerprint and settings, so another split has a table of its own; its
    files lie in ``folder``, under a name of their own. Of two jobs that build
    at once both read the table that is there first. Beside it stands a table
    of episodes, see :func:`cached_episodes`.
    """
    name = table_name(prefix, fingerprint, settings)
    if not spark.catalog.tableExists(name):
        order = [*keys, "idx"]
        rows = build().repartition(buckets, *order)
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        try:
            rows.write.bucketBy(buckets, *order).sortBy(*order).option("path", path).format("parquet").saveAsTable(name)
        except AnalysisException:
            if not spark.catalog.tableExists(name):
                raise
        told = spark.table(name).groupBy(*keys).agg(F.count("*").alias("frames"), F.min("idx").alias("first"), F.max("idx").alias("last"))
        try:
            told.withColumn("fingerprint", F.lit(fingerprint)).write.option("path", f"{path}-episodes").format("parquet").saveAsTable(f"{name}_episodes")
        except AnalysisException:
            if not spark.catalog.tableExists(f"{name}_episodes"):
                raise
    return spark.table(name)


def cached_episodes(spark: SparkSession, prefix: str, fingerprint: str, settings: dict | None = None) -> DataFrame:
    """(keys, frames, first, last, fingerprint) of the episodes of a cached split; windows are laid out by it without reading a frame."""
    return spark.table(f"{table_name(prefix, fingerprint, settings)}_episodes")
