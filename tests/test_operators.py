"""Known vectors and edge cases of functions and operators."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import checks, series
from quern.operators import folds, frames, graph, quality, relations, stats, temporal
from quern.plans import catalog
from quern.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_feature_block(spark):
    rows = spark.createDataFrame([(0, 10.0, 1.0), (1, 12.0, 4.0), (2, 15.0, 2.0)], "t int, a double, b double").withColumn("e", F.lit(1))
    got = temporal.feature_block(rows, ["e"], ["t"], ["a", "b"]).orderBy("t").collect()
    assert [[r.a, r.b, r.a_delta, r.b_delta, r.a_velocity, r.b_velocity] for r in got] == [
        [10, 1, 0, 0, 0, 0],
        [12, 4, 2, 3, 2, 3],
        [15, 2, 5, 1, 3, -2],
    ]


def test_resampling(spark):
    at = series.resample_rint(F.lit(30).cast("long"), 6, F.lit(10.0), F.lit(6.0), F.lit(1))
    assert value(spark, at) == [1, 3, 4, 6, 8, 9]
    assert value(spark, series.resample_half_up(16, F.lit(10.0), F.lit(6.0))) == [0, 2, 3, 5, 7, 8, 10, 12, 13, 15, 17, 18, 20, 22, 23, 25]


def test_hop_windows_have_a_tail(spark):
    starts = series.hop_starts(F.lit(20), F.lit(15), F.lit(100))
    assert value(spark, starts) == [0, 4]
    assert value(spark, series.hop_starts(F.lit(10), F.lit(15), F.lit(1))) == []


def test_short_policies(spark):
    rows = spark.createDataFrame([(10,), (16,), (20,)], "n int")
    assert quality.short_episodes(rows, F.col("n"), F.lit(16), "filter").count() == 2
    assert quality.short_episodes(rows, F.col("n"), F.lit(16), "pad").count() == 3
    with pytest.raises(Exception, match="too short"):
        quality.short_episodes(rows, F.col("n"), F.lit(16), "error").collect()


def test_robust_statistics_leave_the_last_frame_out(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, 2.0, 4.0, 999.0))], "e int, t int, v double").withColumn("j", F.lit("x"))
    r = stats.robust_without_last(rows, ["e"], ["t"], ["j"], "v").first()
    assert (r.n, r["median"], r.iqr, r.scale) == (3, 2.0, 2.0, 2.0)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_audit_of_ragged_vectors(spark):
    """Each dimension's indices are compared as a distinct count would; nulls are never there once."""
    rows = [("a", 1, [1.0, 2.0, 3.0]), ("a", 1, [4.0]), ("a", 2, [5.0, float("nan")]), ("b", 1, [1.0]), ("b", 2, [2.0]), ("c", None, [1.0]), ("c", 3, [1.0, 2.0]), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    found = {(r.g, r.dim): (r.n, r.finite, r.unique_index) for r in quality.vector_audit(df, ["g"], "i", "v").collect()}
    want = {}
    for g in ("a", "b", "c", None):
        for dim in range(3):
            if own := [(i, v[dim]) for h, i, v in rows if h == g and len(v) > dim]:
                want[g, dim] = (len(own), all(math.isfinite(x) for _, x in own), len({i for i, _ in own if i is not None}) == len(own))
    assert found == want


def test_checks(spark):
    assert value(spark, checks.is_sha256(F.lit("a" * 64))) and not value(spark, checks.is_sha256(F.lit("A" * 64)))
    assert not value(spark, checks.is_finite_vector(F.array(F.lit(1.0), F.lit(float("nan")))))
    assert not value(spark, checks.is_finite_vector(F.lit(None).cast("array<double>")))
    assert value(spark, checks.is_key_list(F.array(F.lit("a"), F.lit("b")))) and not value(spark, checks.is_key_list(F.array(F.lit("a"), F.lit("a"))))
    assert value(spark, checks.is_safe_path(F.lit("a/b"))) and not value(spark, checks.is_safe_path(F.lit("a/../b")))
    assert value(spark, checks.is_source_index(F.array(*map(F.lit, (1, 3, 3))), F.lit(1)))
    assert not value(spark, checks.is_source_index(F.array(*map(F.lit, (1, 3, 2))), F.lit(1)))


def test_equal_frames(spark):
    a = F.array(*map(F.lit, (0.0, 0.5, 1.0)))
    assert value(spark, frames.l1(a, a)) == 0 and value(spark, frames.psnr(a, a)) == 100
    assert value(spark, frames.masked_l1(a, F.array(*map(F.lit, (1.0, 0.5, 0.0))), F.array(*map(F.lit, (1, 0, 0))))) == 1.0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.event_files(spark, str(tmp_path / "in")), "ts", ["event_type"], "value", "1 day", late="1 day")
    events.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r)[:3] for r in events.windowed(rows, "ts", ["event_type"], "value", "1 day").collect()}
    # The newest window is not final yet.
    assert got and got <= want and len({w[0] for w in want - got}) <= 2


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_passages_without_inner_words_are_found(spark, broadcast_rows):
    texts = ["one two three four", "two\u00a0three\u00a0four", "这是一个很长的段落没有空格", "", None, "zone", "a two  three"]
    texts += ["a\tb", "xa\tbcdefg h", " lead", "trail  ", "\n", "😀a 😀b", "abc😀😀 tail of it"]
    items = ["a\tb", "a\tbcdefg", " lead", "il  ", "\n", "  ", " ", "😀 ", "a 😀", "😀😀 tail", "c😀😀", "\ta", "two three four", "two three", "one", "two\u00a0three\u00a0four", "一个很长的段落没有", "一个很长的段落没无", "", None, "e", "absent"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    passages = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in relations.contained_in(docs, passages, broadcast_rows).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x is not None and x in t}


def test_units_tell_their_owners_and_groups(spark):
    rows = [("b", "g1", 2), ("a", "g2", 3), ("a", "g1", 5), ("a", "g1", 1), ('c"', "g9", 4), ("10", "h", 7), ("9", "h", 0)]
    members = graph.unit_members(spark.createDataFrame(rows, "o string, g string, n long"), F.col("o"), F.col("g"), F.col("n"))
    got = {tuple(r) for r in graph.leakage_units(members).select("unit_id", F.to_json("owners"), F.to_json("groups"), "n_owners", "n_groups", "episode_count", "frame_count").collect()}
    want = set()
    for owners, groups, episodes, count in ((["a", "b"], ["g1", "g2"], 4, 11), (['c"'], ["g9"], 1, 4), (["10", "9"], ["h"], 2, 7)):
        told = [json.dumps(x, separators=(",", ":")) for x in (owners, groups)]
        name = hashlib.sha256(f'{{"owners":{told[0]},"validation_groups":{told[1]}}}'.encode()).hexdigest()[:20]
        want.add((f"leakage-unit:{name}", *told, len(owners), len(groups), episodes, count))
    assert got == want
    columns = catalog.queries()["leakage_units"](spark, "/root/testdata/sf0.001").columns
    assert {"owners", "groups"} <= set(columns)
