"""Holdouts over units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import keys


def group_holdout(units: DataFrame, key: str, seed: str, fraction: float) -> DataFrame:
    """(key, score, is_val): units whose score is below the fraction; one at least, and not all."""
    scored = units.select(key).distinct().withColumn("score", keys.score_hex(seed, F.col(key)))
    below = F.col("score") < keys.threshold_hex(fraction) if fraction < 1 else F.lit(True)
    scored = scored.withColumn("below", below)
    ends = scored.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("below")).alias("held"),
        F.min(F.struct("score", key))[key].alias("first"),
        F.max(F.struct("score", key))[key].alias("last"),
    )
    placed = scored.join(F.broadcast(ends))
    own = F.col(key)
    is_val = F.when(F.col("held") == 0, own == F.col("first")).when(F.col("held") == F.col("n"), own != F.col("last")).otherwise(F.col("below"))
    return placed.select(key, "score", is_val.alias("is_val"))


def coverage_of_folds(folds: DataFrame, key: str) -> DataFrame:
    """(key, times, once): how often each key is held out."""
    return folds.groupBy(key).agg(F.count("*").alias("times")).withColumn("once", F.col("times") == 1)
