"""Queries on statistics, normalization and command-state errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import series
from quern.operators import fitted, quality, stats, temporal
from quern.plans.registry import query
from quern.plans.windows import KEYS, ORDER, E, W, events
from quern.storage import new_path
from quern.tables import table


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("""SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS most, round(sum(value), 2) AS total,
  round(stddev_pop(value), 6) AS std, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def episode_audit(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.round(F.sum("value"), 2).alias("total"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
        F.count_distinct("event_type").alias("kinds"),
    )


SUMS = """s AS (SELECT event_type, count(*) AS n, sum(value) AS total, sum(value * value) AS squares, min(value) AS least, max(value) AS most
  FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY event_type)"""
STD = "sqrt(greatest(squares / n - (total / n) * (total / n), 0))"


@query(f"""WITH {SUMS} SELECT event_type, n, round(total, 4) AS total, round(squares, 3) AS squares, least, most,
  round(total / n, 6) AS mean, round({STD}, 6) AS std FROM s""")
def streaming_stats(spark, d):
    out = stats.sufficient(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("total", 4).alias("total"), F.round("squares", 3).alias("squares"), "least", "most", *r6("mean", "std"))


@query(f"WITH {SUMS} SELECT event_type, n, round(total / n, 6) AS mean, round(greatest({STD}, 15.0), 6) AS std FROM s")
def gaussian_stats(spark, d):
    return stats.gaussian(table(spark, d, "events"), ["event_type"], "value", 15.0).select("event_type", "n", *r6("mean", "std"))


ROBUST = """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.75) AS q3,
  stddev_pop(value) AS std FROM events GROUP BY event_type),
r AS (SELECT event_type, center, CASE WHEN (q3 - q1) / 1.349 <= 1e-4 THEN greatest(std, 1e-4) ELSE (q3 - q1) / 1.349 END AS scale FROM q)"""


@query(f"WITH {ROBUST} SELECT event_type, round(center, 6) AS center, round(scale, 6) AS scale FROM r")
def robust_stats_a(spark, d):
    return stats.robust(table(spark, d, "events"), ["event_type"], "value").select("event_type", *r6("center", "scale"))


@query(f"""WITH {E}, l AS (SELECT *, lead(1) OVER {W} AS more FROM e),
q AS (SELECT user_id, event_type, count(*) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
  FROM l WHERE more IS NOT NULL GROUP BY user_id, event_type)
SELECT user_id, event_type, n, round(median, 6) AS median, round(iqr, 6) AS iqr, round(CASE WHEN iqr >= 1e-6 THEN iqr ELSE 1.0 END, 6) AS scale FROM q""")
def robust_stats_b(spark, d):
    out = stats.robust_without_last(events(spark, d), KEYS, ORDER, ["user_id", "event_type"], "v")
    return out.select("user_id", "event_type", "n", *r6("median", "iqr", "scale"))


def _scaled(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return rows.join(stats.robust(rows, ["event_type"], "value"), "event_type")


@query(f"WITH {ROBUST} SELECT event_id, round(least(greatest((value - center) / scale, -1.5), 1.5), 6) AS z FROM events JOIN r USING (event_type)")
def normalize_clip(spark, d):
    z = stats.normalized(F.col("value"), F.col("center"), F.col("scale"), 1.5)
    return _scaled(spark, d).select("event_id", F.round(z, 6).alias("z"))


@query(f"""WITH {ROBUST}, z AS (SELECT event_id, value, center, scale, (value - center) / scale AS z FROM events JOIN r USING (event_type))
SELECT event_id, round(z * scale + center, 6) AS restored, abs(z * scale + center - value) < 1e-9 AS same FROM z WHERE abs(z) <= 1.5""")
def inverse_normalize(spark, d):
    z = stats.normalized(F.col("value"), F.col("center"), F.col("scale"))
    rows = _scaled(spark, d).withColumn("z", z).where("abs(z) <= 1.5")
    back = stats.restored(F.col("z"), F.col("center"), F.col("scale"))
    return rows.select("event_id", F.round(back, 6).alias("restored"), (F.abs(back - F.col("value")) < 1e-9).alias("same"))


PAIRS = f"""{E}, p AS (SELECT a.user_id, a.event_type, l.lag, a.v AS c, b.k AS s FROM e a, range(0, 6) AS l(lag), e b
  WHERE b.user_id = a.user_id AND b.idx = a.idx + l.lag AND b.k IS NOT NULL)"""
MAE = "avg(abs(s - c))"
RMSE = "sqrt(avg((s - c) * (s - c)))"
VAR = "greatest(sum({0} * {0}) / count(*) - (sum({0}) / count(*)) * (sum({0}) / count(*)), 1e-24)"
CORR = f"(sum(c * s) / count(*) - sum(c) / count(*) * (sum(s) / count(*))) / sqrt({VAR.format('c')} * {VAR.format('s')})"


def _pairs(spark, d, most=5):
    return temporal.lagged_pairs(events(spark, d), KEYS, ORDER, "v", "k", most)


@query(f"WITH {PAIRS} SELECT lag::INT AS lag, count(*) AS n, round({MAE}, 6) AS mae, round({RMSE}, 6) AS rmse FROM p GROUP BY lag")
def lag_error_table(spark, d):
    out = _pairs(spark, d).groupBy("lag").agg(*stats.errors([]))
    return out.select("lag", "n", *r6("mae", "rmse"))


@query(f"WITH {PAIRS} SELECT lag::INT AS lag, round({CORR}, 6) AS corr FROM p GROUP BY lag")
def lag_correlation(spark, d):
    return _pairs(spark, d).groupBy("lag").agg(*stats.errors([])).select("lag", *r6("corr"))


@query(f"""WITH {PAIRS}, m AS (SELECT user_id, lag, round({MAE}, 9) AS mae FROM p GROUP BY user_id, lag)
SELECT user_id, arg_min(lag, (mae, lag))::INT AS best_lag, round(min(mae), 6) AS mae FROM m GROUP BY user_id""")
def best_lag(spark, d):
    m = _pairs(spark, d).groupBy("user_id", "lag").agg(F.round(F.avg(F.abs(F.col("state") - F.col("command"))), 9).alias("mae"))
    return m.groupBy("user_id").agg(F.min(F.struct("mae", "lag")).alias("b")).select("user_id", F.col("b.lag").alias("best_lag"), F.round("b.mae", 6).alias("mae"))


@query(f"""WITH {E}, n AS (SELECT v - k AS x, lead(k) OVER {W} - k AS y FROM e)
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM n WHERE y IS NOT NULL""")
def servo_ols(spark, d):
    step = F.lead("k").over(series.along(KEYS, ORDER)) - F.col("k")
    rows = events(spark, d).select((F.col("v") - F.col("k")).alias("x"), step.alias("y")).where("y is not null")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept")
    )


@query(f"WITH {PAIRS} SELECT user_id, count(*) AS n, round(sum(abs(s - c)), 2) AS total FROM p WHERE lag = 0 GROUP BY user_id")
def dataset_mae_rank(spark, d):
    """Users by their mean error, greatest last; a sum and a count are what can be compared exactly."""
    error = F.abs(F.col("state") - F.col("command"))
    out = _pairs(spark, d, 0).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(error), 2).alias("total"))
    return out.orderBy(F.col("total") / F.col("n"), "user_id")


@query(f"""WITH {PAIRS} SELECT coalesce(lag, -1)::INT AS lag, coalesce(event_type, '*') AS event_type, count(*) AS n, round({MAE}, 6) AS mae,
  round({RMSE}, 6) AS rmse FROM p GROUP BY GROUPING SETS ((), (lag), (event_type))""")
def grouping_sets_error(spark, d):
    w = series.along(KEYS, ORDER)
    states = F.array(*[F.struct(F.lit(i).alias("lag"), F.lead("k", i).over(w).alias("state")) for i in range(6)])
    made = events(spark, d).select("event_type", F.col("v").alias("command"), states.alias("states"))
    rows = made.select("event_type", "command", F.inline("states")).where("state is not null")
    out = rows.groupingSets([[], ["lag"], ["event_type"]], "lag", "event_type").agg(*stats.errors([]))
    return out.select(
        F.coalesce("lag", F.lit(-1)).cast("int").alias("lag"), F.coalesce("event_type", F.lit("*")).alias("event_type"), "n", *r6("mae", "rmse")
    )


@query(f"""WITH {E}, x AS (SELECT event_type, abs(v - k) AS e FROM e)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN e < 10.0 THEN 0.5 * e * e / 10.0 ELSE e - 5.0 END), 6) AS loss FROM x GROUP BY event_type""")
def smooth_l1(spark, d):
    loss = series.smooth_l1(F.col("v") - F.col("k"), 10.0)
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("loss"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice * (l_returnflag = 'R')::INT) / greatest(sum((l_returnflag = 'R')::INT), 1), 4) AS mean_returned
FROM lineitem GROUP BY l_suppkey""")
def masked_mean(spark, d):
    mean = series.masked_mean(F.col("l_extendedprice"), F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(mean, 4).alias("mean_returned"))


@query("""WITH u AS (SELECT label, vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
t AS (SELECT label, dim, avg(x) AS c, greatest(stddev_pop(x), 1e-4) AS s FROM u GROUP BY label, dim)
SELECT vec_id, round(sum((x - c) / s), 5) AS total, round(max((x - c) / s), 5) AS most, round(sum(x), 5) AS untouched FROM u JOIN t USING (label, dim) GROUP BY vec_id""")
def gaussian_transform(spark, d):
    """Vectors normalized by the means and deviations of their label, without a limit, and by statistics that change nothing."""
    rows = table(spark, d, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    z = stats.standardized(F.col("x"), F.col("center"), F.col("scale"))
    same = stats.standardized(F.col("x"), *stats.identity_stats(64))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 5)
    out = rows.join(_vector_stats(rows), "label").select("vec_id", z.alias("z"), same.alias("same"))
    return out.select("vec_id", total("z").alias("total"), F.round(F.array_max("z"), 5).alias("most"), total("same").alias("untouched"))


def _vector_stats(rows):
    audit = quality.vector_audit(rows, ["label"], "vec_id", "embedding")
    listed = F.array_sort(F.collect_list(F.struct("dim", "mean", F.greatest("std", F.lit(1e-4)).alias("std"))))
    return audit.groupBy("label").agg(listed.alias("s")).select("label", F.col("s.mean").alias("center"), F.col("s.std").alias("scale"))


@query("""WITH u AS (SELECT label, vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
t AS (SELECT label, dim, avg(x) AS c, greatest(stddev_pop(x), 1e-4) AS s FROM u GROUP BY label, dim), z AS (SELECT dim, c, s FROM t WHERE label = 0)
SELECT t.label, round(sum((t.dim + 1) * t.s / z.s), 6) AS weights, round(0.5 + sum((t.dim + 1) * (t.c - z.c) / z.s), 6) AS bias FROM t JOIN z USING (dim) GROUP BY t.label""")
def reparameterized(spark, d):
    """A line over inputs normalized by label 0's statistics, told anew for those of each label."""
    made = _vector_stats(table(spark, d, "embeddings"))
    old = made.where("label = 0").select(F.col("center").alias("c0"), F.col("scale").alias("s0"))
    weight = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    w, b = stats.reparameterized(weight, F.lit(0.5), (F.col("c0"), F.col("s0")), (F.col("center"), F.col("scale")))
    rows = made.join(F.broadcast(old)).select("label", w.alias("w"), b.alias("bias"))
    return rows.select("label", F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("weights"), F.round("bias", 6).alias("bias"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS dim FROM embeddings),
s AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS side, * FROM e),
p AS (SELECT side, sha256(string_agg(DISTINCT vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR) || chr(10)) AS fingerprint FROM s GROUP BY side)
SELECT side, fingerprint, dim::INT AS dim, count(*) AS n, round(avg(x), 8) AS mean, round(greatest(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 0.001), 6) AS std, true AS reused
FROM s JOIN p USING (side) GROUP BY ALL""")
def fitted_stats(spark, d):
    """Statistics of two splits, each fitted once for its fingerprint and settings, and read when asked for again; both asked for twice."""
    frames = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    folder, out = new_path(spark, "fitted"), None
    for side, held in (("train", F.col("vec_id") % 5 != 0), ("validation", F.col("vec_id") % 5 == 0)):
        mark = fitted.split_fingerprint(table(spark, d, "embeddings").where(held), "vec_id")
        fits = []

        def fit(held=held, fits=fits):
            fits.append(held)
            return stats.gaussian(frames.where(held), ["dim"], "x", 1e-3)

        asked = [fitted.fit_once(spark, folder, mark, {"kind": "gaussian", "min_std": 1e-3}, fit) for _ in range(2)]
        one = asked[1].select(F.lit(side).alias("side"), "fingerprint", "dim", "n", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), F.lit(len(fits) == 1).alias("reused"))
        out = one if out is None else out.unionByName(one)
    return out
