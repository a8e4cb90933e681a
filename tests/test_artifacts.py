import copy
import hashlib
import json

import pytest

from quern.operators import artifacts
from quern.sources import artifacts as source

DIGEST = "ab" * 32
RECORDS = "episode_key string, include_for_training boolean, owner string, repository_id string, validation_group string, exclusion_reasons array<string>"
EPISODES = [(f"{o}/{r}/episode_{i:06d}", i < 3, None, None, None, [] if i < 3 else ["short"]) for o, r in (("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")) for i in range(4)]
INCLUDED = [e[0] for e in EPISODES if e[1]]
ZERO = dict.fromkeys(source.ZERO_CHECKS, 0)


def document():
    folds = []
    for fold_id, owner in (("f0", "a"), ("f1", "b")):
        held = [k for k in INCLUDED if k.startswith(owner)]
        audit = {**ZERO, **dict.fromkeys(source.TRUE_CHECKS, True)}
        summary = {"train_episode_count": len(INCLUDED) - len(held), "validation_episode_count": len(held)}
        folds.append({"fold_id": fold_id, "audit": audit, "summary": summary, "train_episode_keys": [k for k in INCLUDED if k not in held], "validation_episode_keys": held})
    return {
        "schema_version": 1,
        "audit": {"passed": True, "all_fold_audits_passed": True},
        "source_manifest": {"sha256": DIGEST, "total_record_count": len(EPISODES), "included_episode_count": len(INCLUDED)},
        "folds": folds,
    }


def read(spark, tmp_path, doc, schema=source.FOLDS):
    path = tmp_path / "artifact.json"
    path.write_text(json.dumps(doc, indent=2) if not isinstance(doc, str) else doc)
    return source.parsed(source.documents(spark, str(path)), schema)


@pytest.fixture(scope="module")
def manifest(spark):
    return artifacts.manifest_rows(spark.createDataFrame(EPISODES, RECORDS)).cache()


def test_a_sound_artifact_of_many_lines(spark, manifest, tmp_path):
    made = read(spark, tmp_path, document())
    assert made.first().artifact_sha256 == hashlib.sha256((tmp_path / "artifact.json").read_bytes()).hexdigest()
    found = artifacts.findings(made, manifest, DIGEST).collect()
    assert all(r.ok for r in found) and len(found) == 7 + 2 * 14
    sides = {(r.side, r.key) for r in artifacts.audited_fold(made, manifest, DIGEST, "f1").collect()}
    assert sides == {("validation" if k.startswith("b") else "train", k) for k in INCLUDED}


def change(doc, what):
    f0 = doc["folds"][0]
    match what:
        case "flag":
            f0["audit"]["train_nonempty"] = False
        case "word for a flag":
            f0["audit"]["passed"] = "yes"
        case "no count":
            del f0["audit"]["unknown_episode_count"]
        case "count":
            f0["audit"]["missing_episode_count"] = 1
        case "summary":
            f0["summary"]["train_episode_count"] += 1
        case "owner":
            f0["train_episode_keys"].append(f0["validation_episode_keys"].pop())
        case "twice":
            f0["train_episode_keys"].append(f0["train_episode_keys"][0])
        case "unknown":
            f0["validation_episode_keys"].append("d/d/episode_000000")
        case "excluded":
            f0["validation_episode_keys"].append("a/x/episode_000003")
        case "empty":
            f0["train_episode_keys"] = []
        case "null list":
            f0["train_episode_keys"] = None
        case "version":
            doc["schema_version"] = 2
        case "overall":
            doc["audit"]["passed"] = False
        case "no audit":
            del doc["audit"]
        case "manifest":
            doc["source_manifest"]["sha256"] = "cd" * 32
        case "records":
            doc["source_manifest"]["total_record_count"] -= 1
        case "same id":
            doc["folds"][1]["fold_id"] = "f0"


BROKEN = {
    "flag": {"train_nonempty"},
    "word for a flag": {"passed"},
    "no count": {"unknown_episode_count"},
    "count": {"missing_episode_count"},
    "summary": {"train_episode_count"},
    "owner": {"passed", "owner_overlap_count", "repository_overlap_count", "validation_group_overlap_count", "train_episode_count", "validation_episode_count"},
    "twice": {"passed", "duplicate_train_episode_key_count"},
    "unknown": {"passed", "complete_partition", "unknown_episode_count", "validation_episode_count"},
    "excluded": {"passed", "complete_partition", "unknown_episode_count", "validation_episode_count"},
    "empty": {"passed", "complete_partition", "train_nonempty", "missing_episode_count", "train_episode_count"},
    "null list": {"passed", "complete_partition", "train_nonempty", "missing_episode_count", "train_episode_count"},
    "version": {"schema_version"},
    "overall": {"audit_passed"},
    "no audit": {"audit_passed", "all_fold_audits_passed"},
    "manifest": {"manifest_sha256"},
    "records": {"total_record_count"},
}


@pytest.mark.parametrize("what", sorted(BROKEN))
def test_each_contradiction_is_found_and_refused(spark, manifest, tmp_path, what):
    doc = document()
    change(doc, what)
    made = read(spark, tmp_path, doc)
    found = {(r.fold_id, r.check) for r in artifacts.findings(made, manifest, DIGEST).collect() if not r.ok}
    fold = None if what in ("version", "overall", "no audit", "manifest", "records") else "f0"
    assert found == {(fold, c) for c in BROKEN[what]}
    with pytest.raises(ValueError, match="fold 'f0'"):
        artifacts.audited_fold(made, manifest, DIGEST, "f0")


def test_other_faults(spark, manifest, tmp_path):
    doc = document()
    change(doc, "same id")
    with pytest.raises(ValueError, match="repeated_fold_id"):
        artifacts.audited_fold(read(spark, tmp_path, doc), manifest, DIGEST, "f0")
    with pytest.raises(ValueError, match="no fold 'f7'"):
        artifacts.audited_fold(read(spark, tmp_path, document()), manifest, DIGEST, "f7")
    with pytest.raises(ValueError, match="no fold"):
        artifacts.audited_fold(read(spark, tmp_path, "{not json"), manifest, DIGEST, "f0")
    twice = manifest.unionByName(manifest.limit(1))
    assert "repeated_manifest_keys" in {r.check for r in artifacts.findings(read(spark, tmp_path, document()), twice, DIGEST).collect() if not r.ok}


def prints(keys):
    return hashlib.sha256("".join(k + "\n" for k in sorted(keys)).encode()).hexdigest()


def pristine():
    official = [e[0] for e in EPISODES if "/y/" in e[0] or "/z/" in e[0]]
    held = [k for k in official if k in INCLUDED]
    return {
        "schema_version": 1,
        "artifact_type": "checkpoint_pristine_split",
        "split_id": "v1",
        "submission_kit_used": False,
        "evaluation_data_used": False,
        "source_manifest": {"sha256": DIGEST, "included_episode_count": len(INCLUDED)},
        "source_train_metadata": {"sha256": "meta"},
        "official_validation_examples": [{"episode_key": k, "video_key": "top"} for k in official],
        "usable_validation_episode_keys": held,
        "continuation_train_fingerprint": prints(set(INCLUDED) - set(held)),
        "usable_validation_fingerprint": prints(held),
        "audit": {"passed": True},
    }


def test_pristine_split(spark, manifest, tmp_path):
    doc = pristine()
    split = lambda d, **more: artifacts.audited_pristine(read(spark, tmp_path, d, source.PRISTINE), manifest, **{"manifest_sha256": DIGEST, "metadata_sha256": "meta", "split_id": "v1", "official_size": 8, **more})
    held = set(doc["usable_validation_episode_keys"])
    assert {(r.side, r.key) for r in split(doc).collect()} == {("validation" if k in held else "train", k) for k in INCLUDED}
    faults = {
        "split_id": {"split_id": "v2"},
        "no_submission_kit": {"submission_kit_used": None},
        "validation_fingerprint": {"usable_validation_fingerprint": prints(INCLUDED)},
        "usable_not_official": {"usable_validation_episode_keys": [*held, INCLUDED[0]]},
        "usable_not_included": {"usable_validation_episode_keys": [*held, "a/y/episode_000003"]},
        "usable_is_empty": {"usable_validation_episode_keys": []},
        "official_episodes": {"official_validation_examples": doc["official_validation_examples"][:-1]},
        "included_episode_count": {"source_manifest": {"sha256": DIGEST, "included_episode_count": 5}},
    }
    for check, wrong in faults.items():
        with pytest.raises(ValueError, match=check):
            split({**copy.deepcopy(doc), **wrong})
    with pytest.raises(ValueError, match="metadata_sha256"):
        split(doc, metadata_sha256="other")
    assert split(doc, metadata_sha256=None).count() == len(INCLUDED)


def test_sides_and_counts_of_a_split_that_is_made(spark, manifest):
    rows = [(e[0],) for e in EPISODES if "/z/" in e[0]] + [("b/z/episode_000000",), ("no/such/episode_000001",)]
    sides = artifacts.pristine_sides(spark.createDataFrame(rows, "episode_key string"), manifest)
    by = {r.key: (r.side, r.reasons) for r in sides.collect()}
    assert by["b/z/episode_000000"] == ("validation", []) and by["b/z/episode_000003"] == ("excluded", ["short"])
    assert by["no/such/episode_000001"][0] == "unknown" and len(by) == len(INCLUDED) + 2
    counts = {r.check: r.counted for r in artifacts.pristine_audit(spark.createDataFrame(rows, "episode_key string"), sides).collect()}
    assert counts == {"official_examples": 6, "official_episodes": 5, "train_episodes": 9, "usable_validation": 3, "excluded_official": 1, "unknown_official": 1}


def stored(spark, docs, path, schema):
    docs.write.text(str(path))
    return source.parsed(source.documents(spark, str(path), lines=True), schema)


@pytest.mark.parametrize("document_keys", [2, 10_000])
def test_artifacts_that_are_made_hold(spark, manifest, tmp_path, document_keys):
    """Folds and a pristine split go into documents, in one or in many, come back, and pass every check."""
    rows = [(f["fold_id"], s, k) for f in document()["folds"] for s in ("train", "validation") for k in f[f"{s}_episode_keys"]]
    listed = spark.createDataFrame(rows, "fold_id string, side string, key string")
    docs = artifacts.fold_documents(listed, manifest, DIGEST, document_keys)
    made = stored(spark, docs, tmp_path / "folds", source.FOLDS)
    assert all(r.ok for r in artifacts.findings(made, manifest, DIGEST).collect())
    assert made.count() == 2 if document_keys > 100 else made.count() > 8
    assert {(r.fold_id, r.side, r.key) for r in source.members(made).collect()} == set(rows)
    examples = [(e["episode_key"], "top") for e in pristine()["official_validation_examples"]]
    official = spark.createDataFrame(examples, "episode_key string, video_key string")
    docs = artifacts.pristine_documents(official, manifest, DIGEST, "meta", "v1", 8, document_keys)
    excluded = sorted(x["episode_key"] for r in docs.collect() for x in json.loads(r.value)["manifest_excluded_official_validation"])
    assert excluded == ["a/y/episode_000003", "b/z/episode_000003"]
    made = stored(spark, docs, tmp_path / "pristine", source.PRISTINE)
    split = artifacts.audited_pristine(made, manifest, DIGEST, "meta", "v1", 8)
    held = set(pristine()["usable_validation_episode_keys"])
    assert {(r.side, r.key) for r in split.collect()} == {("validation" if k in held else "train", k) for k in INCLUDED}
    with pytest.raises(ValueError, match="artifact_type"):
        artifacts.audited_pristine(made, manifest, DIGEST, "meta", "v1", 8, artifact_type="another")


def test_nothing_is_made_of_what_fails(spark, manifest):
    rows = [("f0", "train", k) for k in INCLUDED] + [("f0", "validation", INCLUDED[0])]
    with pytest.raises(ValueError, match="fail their audit: f0"):
        artifacts.fold_documents(spark.createDataFrame(rows, "fold_id string, side string, key string"), manifest, DIGEST)
    official = lambda *keys: spark.createDataFrame([(k, "top") for k in keys], "episode_key string, video_key string")
    make = lambda size, *keys: artifacts.pristine_documents(official(*keys), manifest, DIGEST, "meta", "v1", size)
    for said, size, keys in (("official_examples .1.", 2, INCLUDED[:1]), ("official_episodes .1.", 2, INCLUDED[:1] * 2), ("unknown_official", 1, ["x/y/z"]), ("train_episodes", len(INCLUDED), INCLUDED), ("usable_validation", 1, ["a/x/episode_000003"])):
        with pytest.raises(ValueError, match=said):
            make(size, *keys)
