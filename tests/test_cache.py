import re

import pytest
from pyspark.sql import functions as F

from quern.operators import temporal
from quern.sources import cache


@pytest.fixture
def frames(spark):
    return spark.range(6000).select((F.col("id") % 30).alias("user"), (F.col("id") / 30).cast("long").alias("idx"), (F.col("id") * 3).alias("v"))


def test_windows_meet_cached_frames_without_an_exchange(spark, frames, tmp_path):
    calls = []
    build = lambda: calls.append(1) or frames
    held = cache.cached_frames(spark, "frames_a", str(tmp_path), "mark", ["user"], build, buckets=8)
    again = cache.cached_frames(spark, "frames_a", str(tmp_path), "mark", ["user"], build, buckets=8)
    assert calls == [1] and again.count() == 6000
    told = cache.cached_episodes(spark, "frames_a", "mark")
    assert {(r.frames, r.first, r.last, r.fingerprint) for r in told.collect()} == {(200, 0, 199, "mark")} and told.count() == 30
    windows = told.select("user", F.explode(F.expr("sequence(0L, 180L, 20L)")).alias("start"))
    windows = windows.withColumn("indices", F.sequence(F.col("start"), F.col("start") + 15))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = temporal.gather(windows, held, ["user"], "indices", ["v"])
        want = temporal.gather(windows, frames, ["user"], "indices", ["v"])
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        count = lambda df: len(re.findall(r"Exchange hashpartitioning\(user", plan(df)))
        assert count(want) == 2 and count(rows) == 1 and "Bucketed: true" in plan(rows)
        assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_split_has_its_own_table_and_a_late_build_reads_the_first(spark, frames, tmp_path):
    one = cache.cached_frames(spark, "frames_b", str(tmp_path), "x", ["user"], lambda: frames, buckets=4)
    two = cache.cached_frames(spark, "frames_b", str(tmp_path), "y", ["user"], lambda: frames.where("user < 3"), buckets=4)
    assert (one.count(), two.count()) == (6000, 600)

    def late():
        cache.cached_frames(spark, "frames_b", str(tmp_path), "z", ["user"], lambda: frames.where("user = 1"), buckets=4)
        return frames

    assert cache.cached_frames(spark, "frames_b", str(tmp_path), "z", ["user"], late, buckets=4).count() == 200
    assert cache.cached_episodes(spark, "frames_b", "z").count() == 1
