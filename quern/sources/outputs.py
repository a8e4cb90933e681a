"""Sinks: tables that are never overwritten, guarded writes, logs and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.evaluate import require_all


def write_new(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a table that must not be there yet."""
    rows.write.mode("errorifexists").format(kind).save(path)


def write_checked(rows: DataFrame, report: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write only if no rule of the report is broken."""
    require_all(report)
    write_new(rows, path, kind)


def write_lines(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines in a total order, in as many files as there are ranges; names are sorted, so equal rows give equal lines."""
    names = sorted(rows.columns)
    rows.select(names).repartitionByRange(order).sortWithinPartitions(order).write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def retained(checkpoints: DataFrame, step: str, last: int, every: int) -> DataFrame:
    """Checkpoints of distinct steps with ``keep``: the last ones by step, and each whose step is a multiple of ``every``."""
    cut = checkpoints.select(step).orderBy(F.desc(step)).limit(last).agg(F.min(step).alias("_cut"))
    keep = (F.col(step) >= F.col("_cut")) | (F.col(step) % every == 0)
    return checkpoints.join(F.broadcast(cut)).withColumn("keep", keep).drop("_cut")


def write_report(rows: DataFrame, report: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write the report beside the rows, always; the rows only if no rule is broken, and raise otherwise."""
    write_new(report, f"{path.rstrip('/')}-report", "json")
    write_checked(rows, report, path, kind)


def write_manifest(rows: DataFrame, folder: str, key: str, reasons: str = "reasons") -> None:
    """A manifest as JSON lines in the order of its key, with how often each reason excludes and with its totals beside it."""
    folder = folder.rstrip("/")
    write_lines(rows, f"{folder}/episodes", key)
    issues = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    write_new(issues, f"{folder}/issues", "json")
    totals = rows.agg(F.count("*").alias("total"), F.count_if(F.size(reasons) == 0).alias("included"))
    write_new(totals, f"{folder}/totals", "json")


def write_stats(stats: DataFrame, path: str, signature: str) -> None:
    """Statistics as JSON, bound to the split that they were made for."""
    write_new(stats.withColumn("signature", F.lit(signature)), path, "json")
