"""Checked scans, manifests, folds, gates and sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import checks, keys, series
from quern.operators import evaluate, partitions, quality, relations, sampling, selection, stats, temporal
from quern.plans import catalog
from quern.sources import documents, episodes, outputs, records


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_frames_are_checked_as_they_are_read(spark, tmp_path):
    rows = [([float(i)] * 6, [0.5] * 6, i) for i in range(5)]
    schema = "action array<float>, `observation.state` array<float>, frame_index long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "good"))
    out = records.frames(spark, str(tmp_path / "good"), width=6, with_state=True, optional=("frame_index", "task_index"))
    assert [(r.at, r.action[0], r.state[0], r.frame_index, r.task_index) for r in out.orderBy("at").collect()] == [(i, float(i), 0.5, i, None) for i in range(5)]
    plan = records.frames(spark, str(tmp_path / "good")).select("at")._jdf.queryExecution().executedPlan().toString()
    assert "observation.state" not in plan
    for bad in ([1.0] * 5, [], None, [float("nan")] * 6):
        path = str(tmp_path / f"bad{id(bad)}")
        spark.createDataFrame([(bad, [0.0] * 6, 0)], schema).write.parquet(path)
        with pytest.raises(Exception, match="bad vector"):
            records.frames(spark, path, width=6).collect()
    with pytest.raises(ValueError, match="no column for 'x'"):
        records.renamed(out, {"x": ("y",)})
    assert records.renamed(out, {"state": (), "pose": ("action",)}).columns == ["state", "pose"]


def test_manifests_are_refused_if_they_are_spoiled(spark, tmp_path):
    def written(name, lines):
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    good = [json.dumps({"episode_key": f"k{i}", "length": i, "schema_version": 1 + i % 2, "include_for_training": [True, False, None][i % 3]}) for i in range(6)]
    rows = records.manifest(spark, written("good", [*good, " ", ""]))
    snap = records.manifest_snapshot(rows).first()
    assert (snap.total, snap.included, snap.excluded, snap.schema_versions) == (6, 4, 2, [1, 2])
    assert records.manifest(spark, written("good2", good), default=False).where("included").count() == 2
    for name, lines in {
        "twice": [good[0], good[0]],
        "no key": ['{"length": 1}'],
        "negative": ['{"episode_key": "a", "length": -1}'],
        "no json": ["nonsense"],
        "none included": ['{"episode_key": "a", "include_for_training": false}'],
    }.items():
        with pytest.raises(Exception):  # noqa: B017
            records.manifest(spark, written(name, lines)).collect()


def test_statistics_and_listings(spark, tmp_path):
    made = spark.createDataFrame([([1.0, 2.0], [0.5, 0.25])], "center array<double>, iqr array<double>")
    outputs.write_stats(made, str(tmp_path / "stats"), "sig")
    got = records.stats(spark, str(tmp_path / "stats")).first()
    assert (got.center, got.scale) == ([1.0, 2.0], [0.5, 0.25])
    (tmp_path / "bad.json").write_text('{"center": [1.0], "scale": [0.0]}')
    with pytest.raises(Exception, match="statistics"):
        records.stats(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="another split"):
        stats.bound(made.withColumn("signature", F.lit("sig")), F.lit("other")).collect()
    folder = tmp_path / "videos"
    (folder / "in").mkdir(parents=True)
    for name in ("1.mp4", "2.mp4", "in/3.mp4", "x.txt"):
        (folder / name).write_text(name)
    found = episodes.listing(spark, str(folder), "*.mp4")
    expected = spark.createDataFrame([("1.mp4",), ("4.mp4",)], "path string")
    report = {r.rule: r.violations for r in evaluate.assertions(records.inventory_rules(found, expected, str(folder))).collect()}
    assert report == {"nested": 1, "missing": 1, "extra": 2}
    record = episodes.file_records(spark, str(folder / "1.mp4"))
    assert [r.status for r in episodes.verified(record, record).collect()] == ["ok"]


def test_examples_for_each_camera_and_strict_discovery(spark, tmp_path):
    def collection(name, features):
        meta = tmp_path / name / "meta"
        meta.mkdir(parents=True)
        (meta / "info.json").write_text(json.dumps({"fps": 5, "data_path": "d", "video_path": "v", "features": features}))
        (meta / "episodes.jsonl").write_text("\n".join(json.dumps({"episode_index": i, "length": 4 + i}) for i in (0, 3)))

    camera, action = {"dtype": "video", "shape": [4, 4, 3]}, {"dtype": "float32", "shape": [6]}
    collection("a/x", {"action": action, "observation.images.left": camera, "observation.images.top": camera, "observation.images.wrist": camera})
    collection("a/y", {"action": {"dtype": "float32", "shape": [7]}, "observation.images.top": camera})
    rows = episodes.camera_examples(spark, str(tmp_path), least_length=5).collect()
    assert sorted((r.repository_id, r.video_key[-4:], r.episode_index) for r in rows) == [("a/x", ".top", 3), ("a/x", "left", 3)]
    assert episodes.episodes(spark, str(tmp_path), strict=True).count() == 4
    collection("b/z", {"action": action, "observation.images.wrist": camera})
    assert episodes.episodes(spark, str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="no eligible camera"):
        episodes.episodes(spark, str(tmp_path), strict=True).collect()


def test_reports_and_manifests_are_written_beside_the_rows(spark, tmp_path):
    rows = spark.createDataFrame([("b", ["x"]), ("a", []), ("c", ["x", "y"])], "key string, reasons array<string>")
    outputs.write_manifest(rows, str(tmp_path / "m"), "key")
    issues = {r.reason: r.n for r in spark.read.json(str(tmp_path / "m" / "issues")).collect()}
    totals = spark.read.json(str(tmp_path / "m" / "totals")).first()
    assert issues == {"x": 2, "y": 1} and (totals.total, totals.included) == (3, 1)
    broken = evaluate.assertions({"any": rows})
    with pytest.raises(ValueError, match="any"):
        outputs.write_report(rows, broken, str(tmp_path / "t"))
    assert not spark.read.json(str(tmp_path / "t-report")).first().ok and not (tmp_path / "t").exists()
    outputs.write_report(rows, evaluate.assertions({"none": rows.limit(0)}), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3


def test_folds_that_fail_their_audit_are_refused(spark):
    e = spark.createDataFrame([(i, i // 4, "g", i % 5) for i in range(12)], "key int, owner int, segment string, repository int")
    good = spark.createDataFrame([("f", [4, 5, 6, 7, 8, 9, 10, 11], [0, 1, 2, 3])], "fold_id string, train array<int>, validation array<int>")
    assert partitions.audited(partitions.members(good), e, "key", {"owner": "owner"}).count() == 12
    with pytest.raises(ValueError, match="failed_fold"):
        partitions.audited(partitions.members(good), e, "key", {"group": "segment"})
    with pytest.raises(ValueError, match="unknown split"):
        partitions.selected(e, "test", key="key", held=F.lit(True))
    with pytest.raises(ValueError, match="told by"):
        partitions.selected(e, "train", key="key")


def test_joins_that_must_cover_raise(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, m double"), spark.createDataFrame([(1, 5.0)], "k int, m double")
    with pytest.raises(Exception, match="only one report has 2"):
        relations.paired(a, b, "k", "m").collect()
    assert [tuple(r) for r in relations.paired(a.where("k = 1"), b, "k", "m").collect()] == [(1, 2.0, 5.0)]


def test_windows_that_run_out_raise(spark):
    frames = spark.createDataFrame([("u", i, i * 10) for i in range(5)], "user string, idx long, v int")
    windows = spark.createDataFrame([("u", 0, [0, 2, 4])], "user string, start long, indices array<long>")
    assert temporal.gather_all(windows, frames, ["user"], "indices", "v").first()["values"] == [0, 20, 40]
    for bad, error in (([3, 5], "no frame 5"), ([2, 2], "do not increase")):
        with pytest.raises(Exception, match=error):
            temporal.gather_all(windows.withColumn("indices", F.lit(bad).cast("array<bigint>")), frames, ["user"], "indices", "v").collect()
    for fps in (5.0, 0.0):
        with pytest.raises(Exception, match="slower"):
            value(spark, series.source_offsets(4, F.lit(fps), F.lit(6.0)))
    assert value(spark, series.source_offsets(4, F.lit(10.0), F.lit(6.0))) == [0, 2, 3, 5]


def test_json_faults():
    assert documents.faults('{"a": {"k": 1, "k": 2}}', frozenset({"k"})) == (["k"], True, 2)
    assert documents.faults("[[1]]", frozenset()) == ([], False, 2)
    assert documents.faults("{", frozenset()) == documents.faults(None, frozenset()) == ([], False, -1)


def walk(value, path="$"):
    """(path, name, string) of every value below the top."""
    if isinstance(value, dict):
        parts = [(f"{path}.{n}", n, v) for n, v in value.items()]
    else:
        parts = [(f"{path}[{i}]", None, v) for i, v in enumerate(value)] if isinstance(value, list) else []
    for p, n, v in parts:
        yield p, n, v if isinstance(v, str) else None
        yield from walk(v, p)


def test_walk_over_nested_documents(spark):
    import random

    rng = random.Random(4)

    def made(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {rng.choice(["a", "evalScore", "Feature_map", "x y", "ünï", "submission_kit_used", "HTTPScore2"]): made(depth - 1) for _ in range(3)}
        if depth and kind < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, 2.5, True, None, "text", "My Submission-Kit/file", ""])

    values = [made(5) for _ in range(80)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(900, None), (901, "{"), (902, ""), (903, '{"b": [{"a": 1, "a": 2, "c": 1, "c": 1}]}')]
    df = spark.createDataFrame(rows, "id int, t string")
    want = sorted((i, *x) for i, v in enumerate(values) for x in walk(v))
    found = documents.walked(df, "id", "t")
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str) and len(want) > 500
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    words = lambda n: {x for x in re.split("[^a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", n).lower()) if x}
    named = [(i, p, t, "name") for i, p, n, _ in want if n and n != "submission_kit_used" for t in words(n) & {"score", "feature", "submission"}]
    valued = [(i, p, "submission_kit", "value") for i, p, _, s in want if s and "submission_kit" in re.sub("[^a-z0-9]+", "_", s.lower())]
    unread = [(901, "$", None, "malformed"), (902, "$", None, "malformed"), (903, "$.b[0]", "a", "repeated"), (903, "$.b[0]", "c", "repeated")]
    bad = documents.forbidden_paths(df, "id", "t", ("score", "feature", "submission"), ("submission_kit_used",), ("submission_kit",))
    assert sorted((tuple(r) for r in bad.collect()), key=str) == sorted(named + valued + unread, key=str) and named and valued
    documents.require_clean(bad.where("id = 900"), "id")
    with pytest.raises(ValueError, match=r"903 \$\.b\[0\] \(repeated a\)"):
        documents.require_clean(bad.where("id = 903"), "id")
    with pytest.raises(ValueError, match="more than 2 levels"):
        documents.walked(spark.createDataFrame([(1, "[[[1]]]")], "id int, t string"), "id", "t", most_levels=2)


def test_validators(spark):
    assert value(spark, checks.is_eval_action(F.array(*[F.array(*[F.lit(1.0)] * 6)] * 16)))
    assert not value(spark, checks.is_eval_action(F.array(*[F.array(*[F.lit(1.0)] * 5)] * 16)))
    with pytest.raises(Exception, match="unknown mode"):
        value(spark, checks.one_of(F.lit("x"), ("y",), "mode"))
    with pytest.raises(ValueError, match="out of bounds"):
        selection.Policy(factor=0.5)


def test_means_and_differences_that_are_not_finite_raise(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "d string, m double")
    with pytest.raises(Exception, match="not finite"):
        evaluate.domain_means(rows, ["d"], ["m"]).collect()
    with pytest.raises(Exception, match="not finite"):
        selection.sensitivity(rows, ["d"], "m", "m").collect()


def test_quantiles_by_rank_equal_percentiles(spark):
    rows = spark.range(1000).selectExpr("id % 3 as g", "cast(id * 7919 % 1013 as double) as x").union(spark.createDataFrame([(7, 4.0), (7, None)], "g long, x double"))
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    want = rows.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares.values()))).alias("p"))
    got = {r.g: [r[n] for n in shares] for r in stats.quantiles(rows.repartition(5), ["g"], "x", shares).collect()}
    assert {r.g: pytest.approx(r.p) for r in want.collect()} == got
    placed = sampling.numbered_in_groups(rows.where("x is not null"), ["g"], ["x"], "rn", "n").collect()
    assert all(sorted(r.rn for r in placed if r.g == g) == list(range(1, 1 + sum(r.g == g for r in placed))) for g in (0, 1, 2, 7))


def test_no_plan_sorts_a_whole_table_in_one_task(spark):
    for name in ("worst_quartile", "hash_holdout", "checkpoint_retention", "candidate_selection", "metric_report", "paired_sensitivity"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "windowspecdefinition" in line:
                spec = line.split("windowspecdefinition(")[1]
                assert not spec.startswith(("specifiedwindowframe", "1", "0")), (name, line)


def test_duplicate_files_are_counted_by_digest(spark):
    files = spark.createDataFrame([("a", 2, b"xx"), ("b", 2, b"xx"), ("c", 2, b"yy"), ("d", 3, b"xxx")], "path string, length long, content binary")
    rows = quality.exact_file_groups(files).collect()
    assert [(r["size"], r.canonical_member, r.bytes_each) for r in rows] == [(2, "a", 2)]
