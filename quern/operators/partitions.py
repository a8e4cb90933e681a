"""Folds: made from units, held against the episodes they divide, and audited before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.digests import ordered_digest
from quern.operators.evaluate import assertions, require_all

TRAIN, VALIDATION = "train", "validation"


def fold_from_units(units: DataFrame, episodes: DataFrame, unit: str, held: Column) -> DataFrame:
    """``episodes`` (unit, ...) with ``side``: validation where their unit is held out, and train for all the others."""
    chosen = units.where(held).select(unit).distinct().withColumn("_held", F.lit(True))
    side = F.when(F.col("_held"), VALIDATION).otherwise(TRAIN)
    return episodes.join(chosen, unit, "left").withColumn("side", side).drop("_held")


def members(artifact: DataFrame) -> DataFrame:
    """(fold_id, side, key) of folds (fold_id, train, validation) with lists of keys, repeats and all."""
    listed = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("keys")) for s in (TRAIN, VALIDATION)])
    return artifact.select("fold_id", F.inline(listed)).select("fold_id", "side", F.explode("keys").alias("key"))


def partition_values(rows: DataFrame, attribute: str) -> DataFrame:
    """(fold_id, side, value): what each side of each fold has of an attribute."""
    return rows.select("fold_id", "side", F.col(attribute).alias("value")).distinct()


def fold_audit(listed: DataFrame, episodes: DataFrame, key: str, scopes: dict[str, str]) -> DataFrame:
    """One row for each fold of (fold_id, side, key), held against the episodes (key, attributes) that it must divide.

    Columns: ``passed``, whether either side is empty, whether the partition is
    complete, how many keys are listed twice on a side, stand on both, are
    missing or unknown, and for each scope (name: attribute) how many of its
    values stand on both sides. Keys are counted before anything is joined, so
    a fold is never gathered in one place.
    """
    on = lambda side: F.count_if(F.col("side") == side)
    per_key = listed.groupBy("fold_id", F.col("key").alias(key)).agg(on(TRAIN).alias("t"), on(VALIDATION).alias("v"))
    known = episodes.select(key, *scopes.values()).withColumn("known", F.lit(True))
    rows = per_key.join(known, key, "left")
    own = rows.groupBy("fold_id").agg(
        (F.count_if(F.expr("t > 0")) > 0).alias("train_nonempty"),
        (F.count_if(F.expr("v > 0")) > 0).alias("validation_nonempty"),
        F.sum(F.greatest(F.col("t") - 1, F.lit(0))).alias("duplicate_train_count"),
        F.sum(F.greatest(F.col("v") - 1, F.lit(0))).alias("duplicate_validation_count"),
        F.count_if(F.expr("t > 0 and v > 0")).alias("episode_overlap_count"),
        F.count_if(F.expr("known is null")).alias("unknown_episode_count"),
        F.count("known").alias("_found"),
    )
    values = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(a).cast("string").alias("value")) for s, a in scopes.items()])
    sides = rows.where("known").select("fold_id", "t", "v", F.inline(values)).groupBy("fold_id", "scope", "value").agg(
        ((F.max("t") > 0) & (F.max("v") > 0)).alias("both")
    )
    shared = sides.groupBy("fold_id").agg(
        *[F.count_if((F.col("scope") == s) & F.col("both")).alias(f"{s}_overlap_count") for s in scopes]
    )
    total = F.broadcast(episodes.agg(F.count("*").alias("_total")))
    made = own.join(shared, "fold_id", "left").na.fill(0, [f"{s}_overlap_count" for s in scopes]).join(total)
    missing = F.col("_total") - F.col("_found")
    made = made.withColumn("missing_episode_count", missing).withColumn(
        "complete_partition", (F.col("missing_episode_count") == 0) & (F.col("unknown_episode_count") == 0)
    )
    zero = ["duplicate_train_count", "duplicate_validation_count", "episode_overlap_count", *(f"{s}_overlap_count" for s in scopes)]
    passed = F.col("train_nonempty") & F.col("validation_nonempty") & F.col("complete_partition")
    for name in zero:
        passed &= F.col(name) == 0
    return made.withColumn("passed", passed).drop("_found", "_total")


def collection_rules(listed: DataFrame, audits: DataFrame, once: Column) -> dict[str, DataFrame]:
    """What breaks a collection of folds, by rule.

    A failed fold; two folds with one set of held-out keys; and of the folds
    that are marked ``once``, keys that aren't held out exactly once.
    """
    held = listed.where(F.col("side") == VALIDATION).select("fold_id", "key").distinct()
    sets = ordered_digest(held, ["fold_id"], ["key"], "key", "\n", trailing=True)
    times = listed.where(once).groupBy("key").agg(F.count_if(F.col("side") == VALIDATION).alias("times"))
    return {
        "failed_fold": audits.where(~F.col("passed")),
        "equal_validation_sets": sets.groupBy("digest").count().where("count > 1"),
        "not_held_out_once": times.where("times <> 1"),
    }


def audited(listed: DataFrame, episodes: DataFrame, key: str, scopes: dict[str, str]) -> DataFrame:
    """The folds as they are, if every one passes its audit; an error otherwise."""
    require_all(assertions({"failed_fold": fold_audit(listed, episodes, key, scopes).where(~F.col("passed"))}))
    return listed


def selected(
    rows: DataFrame, split: str, *, key: str, fold: DataFrame | None = None, groups: tuple[str, list] | None = None, held: Column | None = None
) -> DataFrame:
    """Rows of one split: ``train``, ``validation`` or ``all``.

    What is held out is told by exactly one of: a fold (side, key), values of
    a column, or a rule. An unknown split, or none or several of these, is an
    error.
    """
    if split == "all":
        return rows
    if split not in (TRAIN, VALIDATION):
        raise ValueError(f"unknown split {split!r}")
    if sum(x is not None for x in (fold, groups, held)) != 1:
        raise ValueError("a split is told by a fold, by groups, or by a rule")
    if fold is not None:
        wanted = fold.where(F.col("side") == split).select(F.col("key").alias(key))
        return rows.join(wanted, key, "left_semi")
    if groups is not None:
        held = F.col(groups[0]).isin(groups[1])
    held = F.coalesce(held, F.lit(False))
    return rows.where(held if split == VALIDATION else ~held)
