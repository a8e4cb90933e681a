import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import fitted, stats


@pytest.fixture
def frames(spark):
    return spark.range(1000).select((F.col("id") % 4).alias("g"), F.concat(F.lit("ep"), F.col("id")).alias("key"), (F.col("id") % 17).cast("double").alias("x"))


def test_a_second_call_reads_no_frames(spark, frames, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return stats.gaussian(frames, ["g"], "x", 1e-3)

    mark = fitted.split_fingerprint(frames)
    assert mark == hashlib.sha256("".join(f"ep{k}\n" for k in sorted(map(str, range(1000)))).encode()).hexdigest()
    first = fitted.fit_once(spark, str(tmp_path), mark, {"eps": 1e-3, "kind": "gaussian"}, fit)
    again = fitted.fit_once(spark, str(tmp_path), mark, {"kind": "gaussian", "eps": 1e-3}, fit)
    assert calls == [1] and sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and first.count() == 4
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Aggregate" not in plan and "Exchange" not in plan
    want = {r.g: (r.n, r.mean, r.std) for r in stats.gaussian(frames, ["g"], "x", 1e-3).collect()}
    assert {r.g: (r.n, r.mean, r.std) for r in again.collect()} == want


def test_another_split_or_settings_fit_anew(spark, frames, tmp_path):
    calls = []
    fit = lambda: calls.append(1) or stats.gaussian(frames, ["g"], "x", 1e-3)
    for mark, settings in (("a", {"s": 1}), ("b", {"s": 1}), ("a", {"s": 2}), ("a", {"s": 1})):
        fitted.fit_once(spark, str(tmp_path), mark, settings, fit)
    assert len(calls) == 3
    assert fitted.split_fingerprint(frames.limit(0)) == hashlib.sha256().hexdigest()


def test_a_fit_that_fails_leaves_nothing(spark, frames, tmp_path):
    bad = lambda: frames.select("g", F.when(F.col("x") > 15, F.raise_error(F.lit("broken"))).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        fitted.fit_once(spark, str(tmp_path), "a", {}, bad)
    assert not fitted.committed(spark, str(tmp_path / fitted.name_of("a", {})))
    assert fitted.fit_once(spark, str(tmp_path), "a", {}, lambda: stats.gaussian(frames, ["g"], "x", 1e-3)).count() == 4


def test_two_jobs_at_once_agree(spark, frames, tmp_path):
    """Both fit, as neither finds the other's; what one commits is what both read."""
    gate, out = threading.Barrier(2), {}

    def job(k):
        def fit():
            gate.wait(60)
            return stats.gaussian(frames, ["g"], "x", 1e-3).withColumn("job", F.lit(k))

        out[k] = {r.job for r in fitted.fit_once(spark, str(tmp_path), "a", {}, fit).collect()}

    jobs = [threading.Thread(target=job, args=(k,)) for k in range(2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join(120)
    assert out[0] == out[1] and len(out[0]) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == [fitted.name_of("a", {})]


def test_a_late_one_goes(spark, frames, tmp_path):
    made = [str(tmp_path / n) for n in ("_fit-1", "_fit-2")]
    for m in made:
        frames.limit(3).write.parquet(m)
    assert fitted.commit(spark, made[0], str(tmp_path / "t")) and not fitted.commit(spark, made[1], str(tmp_path / "t"))
    assert not (tmp_path / "_fit-2").exists() and spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_a_table_of_another_split_is_refused(spark, frames, tmp_path):
    path = tmp_path / fitted.name_of("a", {})
    frames.limit(2).withColumn("fingerprint", F.lit("b")).write.parquet(str(path))
    with pytest.raises(ValueError, match="another split"):
        fitted.fit_once(spark, str(tmp_path), "a", {}, lambda: frames)
