"""Split artifacts: JSON documents that list what is trained on and what is held out, beside what their maker counted.

An artifact may be one document, or several that share a header and list
parts of a fold each, so that none has to be larger than a task can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a fold's maker must have found to be true, and what to be 0; fixed names of the format.
TRUE_CHECKS = ("passed", "complete_partition", "train_nonempty", "validation_nonempty")
ZERO_CHECKS = (
    "duplicate_train_episode_key_count",
    "duplicate_validation_episode_key_count",
    "episode_overlap_count",
    "missing_episode_count",
    "owner_overlap_count",
    "repository_overlap_count",
    "unknown_episode_count",
    "validation_group_overlap_count",
)
_AUDIT = ", ".join([*(f"{c}: boolean" for c in TRUE_CHECKS), *(f"{c}: long" for c in ZERO_CHECKS)])
FOLDS = (
    "schema_version long, audit struct<passed: boolean, all_fold_audits_passed: boolean>, "
    "source_manifest struct<sha256: string, total_record_count: long, included_episode_count: long>, "
    f"folds array<struct<fold_id: string, audit: struct<{_AUDIT}>, summary: struct<train_episode_count: long, validation_episode_count: long>, "
    "train_episode_keys: array<string>, validation_episode_keys: array<string>>>"
)
PRISTINE = (
    "schema_version long, artifact_type string, split_id string, submission_kit_used boolean, evaluation_data_used boolean, "
    "source_manifest struct<sha256: string, included_episode_count: long>, source_train_metadata struct<sha256: string>, "
    "official_validation_examples array<struct<episode_key: string, video_key: string>>, usable_validation_episode_keys array<string>, "
    "continuation_train_fingerprint string, usable_validation_fingerprint string, audit struct<passed: boolean>"
)


def documents(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """(path, artifact_sha256, text) of JSON documents: whole files, of any number of lines, or with ``lines`` one in each line."""
    if lines:
        rows = spark.read.text(paths).where("value <> ''")
        return rows.select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("artifact_sha256"), F.col("value").alias("text"))
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.sha2("content", 256).alias("artifact_sha256"), F.decode("content", "UTF-8").alias("text"))


def parsed(docs: DataFrame, schema: str) -> DataFrame:
    """(path, artifact_sha256, a): what is not there, or of another type, is null, and fails the checks on it."""
    return docs.select("path", "artifact_sha256", F.from_json("text", schema).alias("a"))


def headers(artifacts: DataFrame) -> DataFrame:
    """(path, artifact_sha256, and the header's fields) of parsed fold artifacts."""
    a = F.col("a")
    return artifacts.select(
        "path",
        "artifact_sha256",
        a["schema_version"].alias("schema_version"),
        a["audit"]["passed"].alias("passed"),
        a["audit"]["all_fold_audits_passed"].alias("all_fold_audits_passed"),
        a["source_manifest"]["sha256"].alias("manifest_sha256"),
        a["source_manifest"]["total_record_count"].alias("total_record_count"),
        a["source_manifest"]["included_episode_count"].alias("included_episode_count"),
    )


def _folds(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("path", "artifact_sha256", F.explode("a.folds").alias("f"))


def members(artifacts: DataFrame) -> DataFrame:
    """(fold_id, side, key) that parsed fold artifacts list, repeats and all."""
    sides = F.array(
        F.struct(F.lit("train").alias("side"), F.col("f.train_episode_keys").alias("keys")),
        F.struct(F.lit("validation").alias("side"), F.col("f.validation_episode_keys").alias("keys")),
    )
    listed = _folds(artifacts).select(F.col("f.fold_id").alias("fold_id"), F.inline(sides))
    return listed.select("fold_id", "side", F.explode("keys").alias("key"))


def _number(x: Column) -> Column:
    return x.cast("long")


def recorded(artifacts: DataFrame) -> DataFrame:
    """(fold_id, check, recorded, alike): what documents say of a fold, flags as 0 and 1, and whether all of its documents agree."""
    audit, summary = F.col("f.audit"), F.col("f.summary")
    checks = [
        *[(c, _number(audit[c])) for c in (*TRUE_CHECKS, *ZERO_CHECKS)],
        *[(c, summary[c]) for c in ("train_episode_count", "validation_episode_count")],
    ]
    said = F.array(*[F.struct(F.lit(c).alias("check"), x.alias("recorded")) for c, x in checks])
    rows = _folds(artifacts).select(F.col("f.fold_id").alias("fold_id"), F.inline(said))
    unlike = F.count("recorded") < F.count("*")
    alike = F.min("recorded").eqNullSafe(F.max("recorded")) & ~(unlike & (F.count("recorded") > 0))
    return rows.groupBy("fold_id", "check").agg(F.min("recorded").alias("recorded"), alike.alias("alike"))
