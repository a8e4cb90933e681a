import copy
import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import reports
from quern.plans import catalog

A, B = "a" * 64, "b" * 64


def sound():
    samples = [{"dataset_index": i, "repository_id": f"o/r{i % 2}", "episode_index": 3, "metrics": {"l1": i / 7, "ssim": 0.5}} for i in (4, 1, 9)]
    contract = {"stats_sha256": A, "fold_fingerprint": A, "manifest_sha256": B, "fold_artifact_sha256": A, "config_sha256": B, "alignment": "causal", "fold_id": "f0"}
    told = [{"dataset_index": s["dataset_index"], "episode_index": 3, "repository_id": s["repository_id"]} for s in samples]
    return {
        "schema_version": 1,
        "validation_scope": "held_out_train_only",
        "submission_kit_used": False,
        "sample_limit": 3,
        "sample_count": 3,
        "samples": samples,
        "selection_fingerprint": hashlib.sha256(json.dumps({"samples": told}, separators=(",", ":")).encode()).hexdigest(),
        "metrics": {"overall": {"l1": sum(s["metrics"]["l1"] for s in samples) / 3, "ssim": 0.5}, "ranking_metric": "l1"},
        "provenance": {
            "submission_kit_used": False,
            "action_control": "original",
            "train_root": "/data/train",
            "expected_contract": contract,
            "checkpoint_contract": dict(contract),
            "checkpoint_contract_status": "matched",
            "checkpoint": {"sha256": A, "bytes": 5},
            "ordered_config_sha256": B,
            "action_alignment": "causal",
            "configs": [{"path": "c.yaml", "sha256": A, "bytes": 1}],
            "loaded": {"expected_main": 2, "loaded_main": 2, "expected_ema": 1, "loaded_ema": 1, "ema_status": "full", "incompatible": []},
            "train_repository_ids": ["o/t"],
            "validation_repository_ids": ["o/r0", "o/r1"],
            "validation_is_checkpoint_pristine": False,
            "validation_dataset_size": 3,
            "selection_seed": 7,
            "metric_space": "unit",
            "first_frame_hard_clamped": True,
        },
    }


def spoil(path, value):
    doc = sound()
    *inner, last = path.split(".")
    at = doc
    for p in inner:
        at = at[int(p)] if p.isdigit() else at[p]
    if value is KeyError:
        del at[last]
    else:
        at[int(last) if last.isdigit() else last] = value
    return doc


P = "provenance."
FAULTS = [
    ("schema_version", "1x", {"schema_version"}),
    ("schema_version", KeyError, {"schema_version"}),
    ("submission_kit_used", None, {"submission_kit_used"}),
    ("submission_kit_used", "false", {"submission_kit_used"}),
    (P + "submission_kit_used", True, {"provenance_submission_kit_used"}),
    (P + "train_root", "/data/Submission_Kit/train", {"train_root"}),
    (P + "train_root", "/data/train/x", {"train_root"}),
    (P + "train_root", "", {"train_root"}),
    ("sample_limit", 4, {"sample_count"}),
    ("samples.1.dataset_index", 4, {"repeated_dataset_index", "selection_fingerprint"}),
    ("samples.1.repository_id", "", {"sample_identity", "selection_fingerprint"}),
    ("samples.2.metrics.l1", float("nan"), {"l1_not_finite"}),
    ("samples.2.metrics.l1", None, {"l1_not_finite"}),
    ("samples.2.metrics.ssim", 0.6, {"ssim_mean"}),
    ("metrics.overall.l1", 0.0, {"l1_mean"}),
    ("metrics.overall.l1", KeyError, {"l1_mean"}),
    (P + "checkpoint_contract.fold_id", "f1", {"checkpoint_contract"}),
    (P + "checkpoint.sha256", A.upper(), {"checkpoint_sha256"}),
    (P + "expected_contract", KeyError, {"checkpoint_contract", "alignment", "config_sha256", "contract_stats_sha256", "contract_fold_fingerprint", "contract_manifest_sha256", "contract_fold_artifact_sha256", "contract_config_sha256"}),
    (P + "configs", [], {"configs"}),
    (P + "configs.0.bytes", 0, {"configs"}),
    (P + "loaded.loaded_ema", 0, {"checkpoint_load"}),
    (P + "loaded.incompatible", ["w"], {"checkpoint_load"}),
    (P + "train_repository_ids", [], {"train_repository_ids"}),
    (P + "train_repository_ids", ["o/r1", "o/r0"], {"repository_overlap"}),
    (P + "first_frame_hard_clamped", 1, {"first_frame_hard_clamped"}),
    ("provenance", KeyError, None),
]


def found(spark, docs):
    rows = spark.createDataFrame([(i, json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(docs)], "id int, text string")
    return reports.broken(reports.parsed_reports(rows, "text"), "id", reports.contract_rules(F.col("r"), "original"))


def test_each_fault_breaks_its_rules_alone(spark):
    docs = [sound(), *[spoil(path, value) for path, value, _ in FAULTS]]
    by = {}
    for r in found(spark, docs).collect():
        by.setdefault(r.id, set()).add(r.rule)
    assert 0 not in by
    for i, (path, value, want) in enumerate(FAULTS, 1):
        if want is None:
            assert len(by[i]) > 20
        else:
            assert by[i] == want, (path, value)


def test_what_is_shown_and_refused(spark):
    clean = spoil(P + "train_repository_ids", ["o/r1", "o/r0"])
    clean["provenance"]["validation_is_checkpoint_pristine"] = True
    assert found(spark, [clean]).count() == 0
    shown = {r.rule: r.value for r in found(spark, [spoil(P + "train_repository_ids", ["o/r1", "o/r0"]), spoil(P + "action_alignment", None)]).collect()}
    assert shown == {"repository_overlap": "o/r0,o/r1", "alignment": "causal <> null"}
    reports.require_reports(found(spark, [sound()]), "id")
    with pytest.raises(ValueError, match=r"0 checkpoint_bytes \(0\)"):
        reports.require_reports(found(spark, [spoil(P + "checkpoint.bytes", 0)]), "id")
    assert found(spark, ["no json", None]).select("id").distinct().count() == 2


def test_cohorts(spark):
    docs = [(c, json.dumps(d)) for c, d in (("x", sound()), ("x", copy.deepcopy(sound())), ("y", sound()), ("y", spoil(P + "metric_space", None)), ("y", spoil("sample_limit", 5)))]
    rows = reports.parsed_reports(spark.createDataFrame(docs, "c string, text string"), "text")
    out = {(r.c, r.field): (r.reports, r.least, r.most) for r in reports.differing_cohorts(rows, "c", reports.cohort_fields(F.col("r"))).collect()}
    assert out == {("y", "metric_space"): (3, '{"x":"unit"}', "{}"), ("y", "sample_limit"): (3, '{"x":3}', '{"x":5}')}


def against_sql(spark, folder, name, lines):
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    found = sorted(map(str, (tuple(r) for r in catalog.queries()[name](spark, str(folder)).select(*names).collect())))
    assert found == sorted(map(str, cursor.fetchall()))
    return found


def test_a_second_fault_does_not_mend_the_mean(spark, tmp_path):
    """Order 10403 has a mean off by one and its first sample twice, which moves the samples' mean by one as well."""
    lines = [(10403, 1, 16.0), (10403, 2, 10.0), (103, 1, 5.0), (101, 1, 7.0), (101, 2, 8.0), (202, 3, 4.0)]
    found = against_sql(spark, tmp_path, "report_rules", lines)
    assert "(10403, 'l1_mean', 'error', '')" in found


def test_cohorts_count_what_is_alike_and_parse_what_they_compare(spark, tmp_path):
    lines = [(k, i + 1, float(k % 7 + i)) for k in [*range(0, 400, 7), *range(500, 900, 7), 1500, 2994, 2500] for i in range(k % 3 + 1)]
    assert against_sql(spark, tmp_path, "report_cohorts", lines)
    plan = catalog.queries()["report_cohorts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate inline")
    assert above.count("Aggregate [") == 1 and below.count("Aggregate [") == 2
    assert "from_json(StructField(sample_limit" in below


def test_fields_of_cohorts_are_the_same_in_either_schema(spark):
    docs = [json.dumps(d) for d in (sound(), *[spoil(path, value) for path, value, _ in FAULTS])] + ["no json", None, '{"sample_limit": 3, "provenance": [', "[]"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    whole, slim = (
        reports.parsed_reports(rows, "text", schema).select("id", *[x.alias(n) for n, x in reports.cohort_fields(F.col("r")).items()]).orderBy("id").collect()
        for schema in (reports.REPORT, reports.COHORT)
    )
    assert whole == slim
