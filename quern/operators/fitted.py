"""Statistics that are fitted once for a split and its settings, committed, and read from then on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.digests import ordered_digest


def split_fingerprint(keys: DataFrame, key: str = "key") -> str:
    """One digest of all distinct keys of a split in order, a line each; ``""`` of no keys is the digest of nothing."""
    rows = keys.select(F.col(key).cast("string").alias("key")).distinct().withColumn("all", F.lit(0))
    found = ordered_digest(rows, ["all"], ["key"], "key", "\n", trailing=True).first()
    return found.digest if found else hashlib.sha256().hexdigest()


def name_of(fingerprint: str, settings: dict) -> str:
    """What a fit is stored under: a digest of the split's fingerprint and the settings, whatever their order."""
    return hashlib.sha256(json.dumps({"fingerprint": fingerprint, "settings": settings}, sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def committed(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at(f"{path}/_SUCCESS"))


def commit(spark: SparkSession, made: str, path: str) -> bool:
    """Move a written table to where it belongs; of several that are made for one place, the first to come stays, and the others go.

    A rename is one step on file systems that have it. One that comes too late
    is refused, or ends inside the first as a hidden folder, which no reader sees.
    """
    files, at = _files(spark, path)
    first = not files.exists(at(path)) and files.rename(at(made), at(path))
    if files.exists(at(made)):
        files.delete(at(made), True)
    late = f"{path}/{made.rstrip('/').rsplit('/', 1)[1]}"
    if files.exists(at(late)):
        files.delete(at(late), True)
        first = False
    return bool(first)


def fit_once(spark: SparkSession, folder: str, fingerprint: str, settings: dict, fit: Callable[[], DataFrame]) -> DataFrame:
    """The fitted table of a split and settings, with ``fingerprint`` and ``settings`` as columns.

    If the folder has it, it is read, and ``fit`` isn't called. Otherwise what
    ``fit`` gives is written beside, under a name of its own, and committed by
    one rename, so that a job that fails leaves nothing, and of two jobs that
    fit the same at once both read what the first committed. Another split or
    other settings have a table of their own.
    """
    path = f"{folder.rstrip('/')}/{name_of(fingerprint, settings)}"
    if not committed(spark, path):
        told = {"fingerprint": F.lit(fingerprint), "settings": F.lit(json.dumps(settings, sort_keys=True))}
        made = f"{folder.rstrip('/')}/_fit-{uuid.uuid4().hex}"
        fit().withColumns(told).write.parquet(made)
        commit(spark, made, path)
    found = spark.read.parquet(path)
    other = found.where((F.col("fingerprint") != fingerprint) | F.col("fingerprint").isNull()).limit(1)
    if not other.isEmpty():
        raise ValueError(f"fitted on another split: {path}")
    return found
