"""Queries on time series: differences, shifts, resampling and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import series
from quern.operators import quality, temporal
from quern.plans.registry import query
from quern.tables import table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
E = "e AS (SELECT event_id, user_id, ts, event_type, value AS v, json_extract(props, '$.k')::DOUBLE AS k, row_number() OVER w - 1 AS idx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def events(spark, d):
    """Events as frames: an episode is a user, a command the value, a state the property k."""
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts", "event_type", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def frames(spark, d):
    return temporal.framed(events(spark, d), KEYS, ORDER)


@query(f"WITH {E} SELECT event_id, round(v - first_value(v) OVER {W}, 6) AS displacement FROM e")
def displacement(spark, d):
    x = series.displacement(F.col("v"), series.along(KEYS, ORDER))
    return events(spark, d).select("event_id", F.round(x, 6).alias("displacement"))


@query(f"WITH {E} SELECT event_id, round(v - lag(v, 1, v) OVER {W}, 6) AS velocity FROM e")
def velocity(spark, d):
    x = series.velocity(F.col("v"), series.along(KEYS, ORDER))
    return events(spark, d).select("event_id", F.round(x, 6).alias("velocity"))


@query(f"""WITH {E} SELECT event_id, v, k, round(v - first_value(v) OVER {W}, 6) AS v_delta, round(v - lag(v, 1, v) OVER {W}, 6) AS v_velocity,
  round(k - first_value(k) OVER {W}, 6) AS k_delta, round(k - lag(k, 1, k) OVER {W}, 6) AS k_velocity FROM e""")
def feature_block(spark, d):
    out = temporal.feature_block(events(spark, d), KEYS, ORDER, ["v", "k"])
    made = ["v_delta", "v_velocity", "k_delta", "k_velocity"]
    return out.select("event_id", "v", "k", *[F.round(c, 6).alias(c) for c in made])


@query(f"""WITH {E}, n AS (SELECT *, least(greatest((v - 50.0) / 20.0, -2.0), 2.0) / 2.0 AS a FROM e)
SELECT event_id, round(a, 6) AS abs_scaled, round(least(greatest(a - first_value(a) OVER {W}, -1.0), 1.0), 6) AS rel_scaled,
  round(least(greatest(a - lag(a, 1, a) OVER {W}, -1.0), 1.0), 6) AS delta_scaled FROM n""")
def feature_block_scaled(spark, d):
    out = temporal.scaled_feature_block(events(spark, d), KEYS, ORDER, "v", F.lit(50.0), F.lit(20.0), 2.0)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("abs_scaled", "rel_scaled", "delta_scaled")])


@query(f"WITH {E} SELECT event_id, lag(v, 1, 0.0) OVER {W} AS shifted FROM e")
def shift_zero(spark, d):
    return events(spark, d).select("event_id", series.shifted(F.col("v"), series.along(KEYS, ORDER), F.lit(0.0)).alias("shifted"))


@query(f"WITH {E} SELECT event_id, lag(v, 1, v) OVER {W} AS shifted FROM e")
def shift_repeat(spark, d):
    return events(spark, d).select("event_id", series.shifted(F.col("v"), series.along(KEYS, ORDER), F.col("v")).alias("shifted"))


@query(f"WITH {E} SELECT a.event_id, a.idx, b.v AS previous FROM e a JOIN e b ON a.user_id = b.user_id AND b.idx = greatest(a.idx - 1, 0)")
def previous_command(spark, d):
    f = frames(spark, d)
    rows = f.select("event_id", "user_id", "idx")
    return temporal.previous_command(rows, f, KEYS, F.lit(0).cast("long"), "v").select("event_id", "idx", "previous")


RATES = "(VALUES (10.0, 6.0), (15.0, 6.0), (30.0, 6.0), (6.0, 6.0)) AS r(fps, target)"


def _rates(spark):
    return spark.createDataFrame([(10.0, 6.0), (15.0, 6.0), (30.0, 6.0), (6.0, 6.0)], "fps double, target double")


@query(f"""SELECT fps::DOUBLE AS fps, target::DOUBLE AS target, n AS length,
  string_agg(CASE WHEN n < 1 THEN 0 ELSE least(greatest(round_even(i * fps::DOUBLE / target::DOUBLE, 0)::BIGINT + 1, 0), n - 1) END::VARCHAR, ',' ORDER BY i) AS indices
FROM {RATES}, (SELECT DISTINCT count(*) // 4 AS n FROM events GROUP BY user_id UNION SELECT 0) AS l, range(0, 16) AS s(i) GROUP BY fps, target, n""")
def resample_rint(spark, d):
    lengths = _lengths(spark, d).select(F.expr("n div 4").alias("length")).union(spark.range(1)).distinct()
    rows = lengths.join(F.broadcast(_rates(spark)))
    at = series.resample_rint(F.col("length"), 16, F.col("fps"), F.col("target"), F.lit(1))
    return rows.select("fps", "target", "length", F.array_join(at, ",").alias("indices"))


@query("""SELECT p_partkey, (6 + p_size % 25)::DOUBLE AS fps,
  string_agg(floor(i * (6 + p_size % 25)::DOUBLE / 6.0::DOUBLE + 0.5)::BIGINT::VARCHAR, ',' ORDER BY i) AS offsets, true AS increasing
FROM part, range(0, 16) AS s(i) GROUP BY p_partkey, p_size""")
def resample_halfup(spark, d):
    """Parts as sources, with rates from their sizes."""
    at = series.resample_half_up(16, F.col("fps"), F.lit(6.0))
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 25 + 6).cast("double").alias("fps"))
    return rows.select("p_partkey", "fps", F.array_join(at, ",").alias("offsets"), series.is_increasing(at).alias("increasing"))


N = "n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"


def _lengths(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {N} SELECT user_id, n, greatest(n - 1 - round_even(15 * 10.0 / 6.0, 0)::BIGINT, 0) AS max_start,
  n < round_even(69 * 10.0 / 6.0, 0)::BIGINT + 1 AS is_padded FROM n""")
def max_window_start(spark, d):
    rows = quality.short_episodes(_lengths(spark, d), F.col("n"), series.required_length(70, F.lit(10.0), F.lit(6.0)), "pad")
    start = series.max_window_start(F.col("n"), 16, F.lit(10.0), F.lit(6.0))
    return rows.select("user_id", "n", start.alias("max_start"), "is_padded")


@query(f"""WITH {N} SELECT DISTINCT user_id, start FROM (
  SELECT user_id, unnest(list_append(range(0, n - 15, 8), n - 16)) AS start FROM n WHERE n >= 16)""")
def hop_windows(spark, d):
    return temporal.hop_windows(_lengths(spark, d), F.col("n"), F.lit(15), F.lit(8)).select("user_id", "start")


@query(f"""WITH {E}, {N}, w AS (SELECT user_id, unnest(range(0, n - 15, 16)) AS start FROM n WHERE n >= 16)
SELECT w.user_id, w.start, count(*) AS frames, string_agg(CASE WHEN e.idx < w.start + 15 THEN e.event_id END::VARCHAR, ',' ORDER BY e.idx) AS causal,
  round(sum(CASE WHEN e.idx > w.start THEN e.k ELSE 0 END), 6) AS state_sum
FROM w JOIN e ON e.user_id = w.user_id AND e.idx BETWEEN w.start AND w.start + 15 GROUP BY w.user_id, w.start""")
def window_gather(spark, d):
    windows = temporal.hop_windows(_lengths(spark, d), F.col("n"), F.lit(15), F.lit(16), tail=False)
    windows = windows.withColumn("indices", F.sequence(F.col("start"), F.col("start") + 15))
    rows = temporal.gather(windows, frames(spark, d), KEYS, "indices", ["event_id", "k"])
    listed = F.array_sort(F.collect_list(F.when(F.col("at") < 15, F.struct("at", "event_id"))))
    return rows.groupBy("user_id", "start").agg(
        F.count("*").alias("frames"),
        F.array_join(F.transform(listed, lambda x: x["event_id"].cast("string")), ",").alias("causal"),
        F.round(F.sum(F.when(F.col("at") > 0, F.col("k")).otherwise(0.0)), 6).alias("state_sum"),
    )


@query("""WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(range(0, 9), lambda i: t[least(i, len(t) - 1) + 1]), ',') AS turns FROM t""")
def tail_pad(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return turns.select("conv_id", F.array_join(series.tail_repeat(F.col("t"), 9), ",").alias("turns"))


@query("""WITH t AS (SELECT conv_id, CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN 1 ELSE turn END AS turn FROM conversations)
SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM t GROUP BY conv_id""")
def frame_contiguity(spark, d):
    """The first turn of some conversations is numbered as the second to make violations, which the table has none of."""
    turn = F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), 1).otherwise(F.col("turn"))
    rows = table(spark, d, "conversations").select("conv_id", turn.alias("turn"))
    return quality.contiguous(rows, ["conv_id"], "turn")


@query("SELECT l_orderkey, count(*) AS n, count(*) = count(DISTINCT l_linenumber) AS is_unique FROM lineitem GROUP BY l_orderkey")
def unique_index(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), (F.count("*") == F.count_distinct("l_linenumber")).alias("is_unique")
    )


@query(f"WITH {E} SELECT event_id, round(lead(v) OVER {W} - 2 * v + lag(v) OVER {W}, 6) AS acceleration FROM e")
def second_difference(spark, d):
    x = series.second_difference(F.col("v"), series.along(KEYS, ORDER))
    return events(spark, d).select("event_id", F.round(x, 6).alias("acceleration"))


@query(f"""WITH {E}, t AS (SELECT user_id, list(v ORDER BY idx) AS a, arg_min(k, idx) AS s0 FROM e GROUP BY user_id)
SELECT user_id, len(a)::INT AS n, round(list_reduce(list_concat([s0], a[:len(a) - 1]), lambda s, x: s + 0.3 * (x - s) + 0.01), 6) AS last_state FROM t""")
def servo_recurrence(spark, d):
    out = temporal.last_state(frames(spark, d), KEYS, "v", "k", 0.3, 0.01)
    return out.select("user_id", F.col("n").cast("int").alias("n"), F.round("state", 6).alias("last_state"))


@query()
def random_windows(spark, d):
    """Seeded starts, the same as the standard library's generator gives for the digest of the episode."""
    from quern.operators.seeded import random_starts

    return random_starts(_lengths(spark, d), "user_id", "n", windows=4, span=16, seed=0)
