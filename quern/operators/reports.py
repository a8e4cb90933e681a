"""Nested reports held against rules: which report breaks which rule, with the value that breaks it, in one pass.

A rule is a name, a condition on a report's nested fields and the value to
show. All rules of a set are evaluated on a report where it lies, samples and
all, and only what is broken becomes rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import checks, keys

METRICS = "struct<l1: double, ssim: double>"
CONTRACT = (
    "struct<stats_sha256: string, fold_fingerprint: string, manifest_sha256: string, fold_artifact_sha256: string, config_sha256: string, "
    "alignment: string, fold_id: string>"
)
SAMPLE = f"struct<dataset_index: long, repository_id: string, episode_index: long, metrics: {METRICS}>"
PROVENANCE = (
    "struct<submission_kit_used: boolean, action_control: string, train_root: string, "
    f"expected_contract: {CONTRACT}, checkpoint_contract: {CONTRACT}, checkpoint_contract_status: string, "
    "checkpoint: struct<sha256: string, bytes: long>, ordered_config_sha256: string, action_alignment: string, "
    "configs: array<struct<path: string, sha256: string, bytes: long>>, "
    "loaded: struct<expected_main: long, loaded_main: long, expected_ema: long, loaded_ema: long, ema_status: string, incompatible: array<string>>, "
    "train_repository_ids: array<string>, validation_repository_ids: array<string>, validation_is_checkpoint_pristine: boolean, "
    "validation_dataset_size: long, selection_seed: long, metric_space: string, first_frame_hard_clamped: boolean>"
)
REPORT = (
    "schema_version long, validation_scope string, submission_kit_used boolean, sample_limit long, sample_count long, "
    f"samples array<{SAMPLE}>, selection_fingerprint string, metrics struct<overall: {METRICS}, ranking_metric: string>, provenance {PROVENANCE}"
)
#: The fields of a report that :func:`cohort_fields` reads; a parser passes over the others, samples above all.
COHORT = (
    "sample_limit long, metrics struct<ranking_metric: string>, provenance struct<expected_contract: struct<fold_id: string, manifest_sha256: string>, "
    "selection_seed: long, metric_space: string, train_repository_ids: array<string>>"
)
#: Parts of a path that a folder to train on must not have.
NOT_TO_TRAIN_ON = ("eval", "submission_kit", "official_submission_kit")
#: How far a recorded mean may be from the mean of the samples, in parts of it and at least.
RELATIVE, ABSOLUTE = 1e-9, 1e-12


@dataclass(frozen=True)
class Rule:
    name: str
    #: What must hold; null doesn't.
    holds: Column
    #: What is shown where it doesn't.
    value: Column
    severity: str = "error"


def equal(name: str, field: Column, value) -> Rule:
    return Rule(name, field == F.lit(value), field)


def same(name: str, a: Column, b: Column) -> Rule:
    """Both are there and equal; both are shown."""
    shown = F.concat_ws(" <> ", F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null")))
    return Rule(name, a == b, shown)


def positive(name: str, field: Column) -> Rule:
    return Rule(name, field >= 1, field)


def sha256(name: str, field: Column) -> Rule:
    return Rule(name, checks.is_sha256(field), field)


def nonempty(name: str, field: Column) -> Rule:
    return Rule(name, F.size(field) > 0, F.size(field))


def fingerprint(samples: Column) -> Column:
    """Digest of the samples' identities, in their order, as JSON."""
    names = ("dataset_index", "episode_index", "repository_id")
    return keys.canonical_json_digest(F.transform(samples, lambda s: F.struct(*[s[n].alias(n) for n in names])).alias("samples"))


def metric_rules(r: Column, metrics: Iterable[str]) -> list[Rule]:
    """Each metric is finite in every sample, and its recorded mean is that of the samples."""
    out = []
    for m in metrics:
        values = r["samples"]["metrics"][m]
        sound = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
        mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
        said = r["metrics"]["overall"][m]
        close = F.abs(said - mean) <= F.greatest(F.lit(RELATIVE) * F.greatest(F.abs(said), F.abs(mean)), F.lit(ABSOLUTE))
        out += [Rule(f"{m}_not_finite", sound, F.size(F.filter(values, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))))), Rule(f"{m}_mean", ~sound | close, said)]
    return out


def contract_rules(r: Column, control: str, metrics: Iterable[str] = ("l1", "ssim")) -> list[Rule]:
    """What every report must be, on its own."""
    p = r["provenance"]
    contract, indices = p["expected_contract"], F.transform(r["samples"], lambda s: s["dataset_index"])
    parts = F.filter(F.split(F.lower(p["train_root"]), "/"), lambda x: x != "")
    isolated = (F.try_element_at(parts, F.lit(-1)) == "train") & ~F.arrays_overlap(parts, F.lit(list(NOT_TO_TRAIN_ON)))
    n = F.size(r["samples"])
    overlap = F.array_intersect(p["train_repository_ids"], p["validation_repository_ids"])
    loaded = p["loaded"]
    complete = (
        (loaded["expected_main"] >= 1)
        & (loaded["loaded_main"] == loaded["expected_main"])
        & (loaded["expected_ema"] >= 1)
        & (loaded["loaded_ema"] == loaded["expected_ema"])
        & (loaded["ema_status"] == "full")
        & (F.size(loaded["incompatible"]) == 0)
    )
    configs = F.forall(p["configs"], lambda c: (F.length(c["path"]) > 0) & checks.is_sha256(c["sha256"]) & (c["bytes"] >= 1))
    return [
        equal("schema_version", r["schema_version"], 1),
        equal("validation_scope", r["validation_scope"], "held_out_train_only"),
        equal("submission_kit_used", r["submission_kit_used"], False),
        equal("provenance_submission_kit_used", p["submission_kit_used"], False),
        equal("action_control", p["action_control"], control),
        Rule("train_root", isolated, p["train_root"]),
        Rule("sample_count", (r["sample_limit"] >= 1) & (r["sample_count"] == r["sample_limit"]) & (n == r["sample_count"]), n),
        Rule("repeated_dataset_index", F.size(F.array_distinct(indices)) == n, n - F.size(F.array_distinct(indices))),
        Rule("sample_identity", F.forall(r["samples"], lambda s: (s["dataset_index"] >= 0) & (s["episode_index"] >= 0) & (F.length(s["repository_id"]) > 0)), n),
        Rule("selection_fingerprint", r["selection_fingerprint"] == fingerprint(r["samples"]), r["selection_fingerprint"]),
        *metric_rules(r, metrics),
        equal("checkpoint_contract_status", p["checkpoint_contract_status"], "matched"),
        Rule("checkpoint_contract", p["checkpoint_contract"] == contract, F.to_json(p["checkpoint_contract"])),
        sha256("checkpoint_sha256", p["checkpoint"]["sha256"]),
        positive("checkpoint_bytes", p["checkpoint"]["bytes"]),
        *[sha256(f"contract_{c}", contract[c]) for c in ("stats_sha256", "fold_fingerprint", "manifest_sha256", "fold_artifact_sha256", "config_sha256")],
        same("alignment", contract["alignment"], p["action_alignment"]),
        same("config_sha256", p["ordered_config_sha256"], contract["config_sha256"]),
        Rule("configs", (F.size(p["configs"]) > 0) & configs, F.size(p["configs"])),
        Rule("checkpoint_load", complete, F.to_json(loaded)),
        Rule("validation_dataset_size", p["validation_dataset_size"] >= r["sample_count"], p["validation_dataset_size"]),
        nonempty("train_repository_ids", p["train_repository_ids"]),
        nonempty("validation_repository_ids", p["validation_repository_ids"]),
        Rule("repository_overlap", (F.size(overlap) == 0) | p["validation_is_checkpoint_pristine"], F.array_join(F.array_sort(overlap), ",")),
        equal("first_frame_hard_clamped", p["first_frame_hard_clamped"], True),
    ]


def broken(reports: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, severity, value) of each rule that a report breaks; reports are rows with nested fields, read once."""
    made = [
        F.when(~F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.value.cast("string").alias("value")))
        for r in rules
    ]
    return reports.select(key, F.inline(F.array_compact(F.array(*made))))


def cohort_fields(r: Column) -> dict[str, Column]:
    """What reports that are compared must have in common, as JSON."""
    p = r["provenance"]
    fields = {
        "sample_limit": r["sample_limit"],
        "ranking_metric": r["metrics"]["ranking_metric"],
        "fold_id": p["expected_contract"]["fold_id"],
        "manifest_sha256": p["expected_contract"]["manifest_sha256"],
        "selection_seed": p["selection_seed"],
        "metric_space": p["metric_space"],
        "train_repository_ids": p["train_repository_ids"],
    }
    return {name: F.to_json(F.struct(x.alias("x"))) for name, x in fields.items()}


def differing_cohorts(reports: DataFrame, cohort: str, fields: dict[str, Column]) -> DataFrame:
    """(cohort, field, reports, least, most) of fields in which a cohort's reports differ; what is missing is a value too.

    Reports that are alike in all fields are counted first, so a row for each
    field is made of what is distinct alone. Only the least and the greatest
    value of a field are kept on the way.
    """
    alike = reports.groupBy(cohort, F.struct(*[x.alias(n) for n, x in fields.items()]).alias("values")).agg(F.count("*").alias("reports"))
    named = F.array(*[F.struct(F.lit(n).alias("field"), F.col("values")[n].alias("value")) for n in fields])
    long = alike.select(cohort, "reports", F.inline(named))
    ends = long.groupBy(cohort, "field").agg(F.sum("reports").alias("reports"), F.min("value").alias("least"), F.max("value").alias("most"))
    return ends.where("least <> most")


def parsed_reports(rows: DataFrame, text: str, schema: str = REPORT) -> DataFrame:
    """Rows with their JSON ``text`` as the struct ``r``; fields that are missing or of another type are null and break their rules."""
    return rows.withColumn("r", F.from_json(text, schema)).drop(text)


def require_reports(found: DataFrame, key: str) -> None:
    """Raise with the first broken rules that are errors, if there are any."""
    if rows := found.where("severity = 'error'").orderBy(key, "rule").limit(10).collect():
        raise ValueError("broken: " + ", ".join(f"{r[key]} {r.rule} ({r.value})" for r in rows))
