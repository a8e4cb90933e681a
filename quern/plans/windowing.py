"""Queries on the rows of windows: gathered with checks, padded, split, tiled and sampled."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import series
from quern.operators import stats, temporal
from quern.plans.registry import query
from quern.plans.windows import KEYS, N, E, _lengths, frames
from quern.tables import table

LISTS = "t AS (SELECT conv_id, list(length(text) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"


def _lists(spark, d):
    """Conversations as short series: the lengths of their turns."""
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.length("text").alias("x")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", F.col("s.x").alias("a"))


def _joined(values, sep=","):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


@query(f"""WITH {N}, w AS (SELECT user_id, n, n - 1 - 25 AS last, greatest(floor(4 * 10.0 / 6.0 + 0.5), 1)::BIGINT AS stride FROM n WHERE n > 25)
SELECT DISTINCT user_id, start FROM (SELECT user_id, unnest(list_append(range(0, last + 1, stride), last)) AS start FROM w)""")
def native_windows(spark, d):
    """Windows of 16 target frames from a source of 10 a second, every four target frames, with one at the end."""
    fps, target = F.lit(10.0), F.lit(6.0)
    offsets = series.source_offsets(16, fps, target)
    stride = series.native_stride(4, fps, target)
    return temporal.hop_windows(_lengths(spark, d), F.col("n"), F.element_at(offsets, -1), stride).select("user_id", "start")


@query(f"""WITH {E}, {N}, w AS (SELECT user_id, unnest([0, n // 2, n - 1]) AS start, n FROM n)
SELECT w.user_id, w.start, string_agg(e.event_id::VARCHAR, ',' ORDER BY i) AS ids, count(*) FILTER (w.start + 3 * i > n - 1) AS clipped
FROM w, range(0, 8) AS r(i) JOIN e ON e.user_id = w.user_id AND e.idx = least(w.start + 3 * i, n - 1) GROUP BY w.user_id, w.start""")
def window_clip(spark, d):
    """Windows that may run beyond their series: indices are held at the last frame."""
    n = F.col("n")
    starts = F.array(F.lit(0).cast("long"), F.expr("n div 2"), n - 1)
    windows = _lengths(spark, d).select("user_id", "n", F.explode(starts).alias("start"))
    rows = temporal.clipped_gather(windows, frames(spark, d), KEYS, [F.lit(3 * i) for i in range(8)], "n", ["event_id"])
    listed = F.array_sort(F.collect_list(F.struct("at", "event_id")))
    return rows.groupBy("user_id", "start").agg(listed.alias("l"), F.count_if(F.col("clipped")).alias("clipped")).select(
        "user_id", "start", _joined(F.col("l.event_id")).alias("ids"), "clipped"
    )


@query(f"""WITH {E}, {N}, w AS (SELECT user_id, unnest(range(0, n - 15, 16)) AS start FROM n WHERE n >= 16)
SELECT w.user_id, w.start, string_agg(CASE WHEN e.idx < w.start + 15 THEN e.event_id END::VARCHAR, ',' ORDER BY e.idx) AS actions,
  string_agg(CASE WHEN e.idx > w.start THEN e.event_id END::VARCHAR, ',' ORDER BY e.idx) AS states
FROM w JOIN e ON e.user_id = w.user_id AND e.idx BETWEEN w.start AND w.start + 15 GROUP BY w.user_id, w.start""")
def window_pairs(spark, d):
    """What is done at all frames but the last, and what is seen at all but the first; a frame that isn't there is an error."""
    windows = temporal.hop_windows(_lengths(spark, d), F.col("n"), F.lit(15), F.lit(16), tail=False)
    windows = windows.withColumn("indices", F.sequence(F.col("start"), F.col("start") + 15))
    rows = temporal.gather_all(windows, frames(spark, d), ["user_id"], "indices", "event_id")
    ids = F.col("values")
    return rows.select("user_id", "start", _joined(F.slice(ids, 1, 15)).alias("actions"), _joined(F.slice(ids, 2, 15)).alias("states"))


@query(f"""WITH {LISTS} SELECT conv_id, array_to_string([a[least(i, len(a) - 1) + 1] FOR i IN range(0, 16)], ',') AS window_values FROM t""")
def eval_window(spark, d):
    return _lists(spark, d).select("conv_id", _joined(series.eval_window(F.col("a"))).alias("window_values"))


@query(f"""WITH {LISTS}, w AS (SELECT conv_id, [a[least(i, len(a) - 1) + 1] FOR i IN range(0, 16)] AS w FROM t)
SELECT conv_id, array_to_string(w[1:15], ',') AS causal, w[16]::INT AS held FROM w""")
def eval_split(spark, d):
    causal, held = series.causal_split(series.eval_window(F.col("a")))
    return _lists(spark, d).select("conv_id", _joined(causal).alias("causal"), held.alias("held"))


@query(f"""WITH {LISTS}, s AS (SELECT conv_id, conv_id % 3 AS kind, a, CASE conv_id % 3 WHEN 0 THEN a ELSE [a[least(greatest(i, 0), len(a) - 1) + 1] FOR i IN range(-1, 5)] END AS c FROM t),
k AS (SELECT conv_id, c[1:9] AS c FROM s)
SELECT conv_id, array_to_string([c[least(i, len(c))] FOR i IN range(1, 9)], ',') AS actions FROM k""")
def selected_actions(spark, d):
    """Nine frames' actions without the last one: by indices where there are any, and from the start otherwise."""
    none = F.array().cast("array<int>")
    indices = F.when(F.col("conv_id") % 3 == 0, none).otherwise(F.array(*[F.lit(i) for i in range(-1, 5)]))
    return _lists(spark, d).select("conv_id", _joined(series.selected_actions(F.col("a"), indices, F.lit(9))).alias("actions"))


@query("""SELECT vec_id, (64 + 16 * 3)::INT AS n, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS first, 0.0::DOUBLE AS others FROM embeddings""")
def conditioning_payload(spark, d):
    """Clips of which the first frame alone is given."""
    frame = F.slice(F.col("embedding").cast("array<double>"), 1, 16)
    clip = series.first_frame_only(frame, 7)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x))
    first = F.aggregate(F.slice("clip", 1, 16), F.lit(0.0), lambda a, x: a + x)
    out = table(spark, d, "embeddings").select("vec_id", clip.alias("clip"))
    return out.select("vec_id", F.size("clip").alias("n"), F.round(first, 6).alias("first"), total(F.slice("clip", 17, 96)).alias("others"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)
SELECT vec_id, round(list_sum([a[floor(i * 63 / 9.0)::INT + 1] + (i * 63 / 9.0 - floor(i * 63 / 9.0)) * (a[least(floor(i * 63 / 9.0)::INT + 1, 63) + 1] - a[floor(i * 63 / 9.0)::INT + 1])
  FOR i IN range(0, 10)]), 6) AS total, round(a[1], 6) AS first, round(a[64], 6) AS last FROM e""")
def time_interpolation(spark, d):
    """Series of 64 at ten places on straight lines, both ends kept."""
    out = table(spark, d, "embeddings").select("vec_id", series.lerp(F.col("embedding").cast("array<double>"), 10).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", F.round(total, 6).alias("total"), F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.get("x", F.lit(9)), 6).alias("last"))


@query(f"""WITH {N} SELECT user_id, w AS tile, (user_id * 3 + w) % 5 AS window FROM n, range(0, 4) AS r(w)""")
def window_tiles(spark, d):
    """Each episode four times an epoch, every time with another window of five."""
    return temporal.tiled(_lengths(spark, d).select("user_id"), 4).select(
        "user_id", "tile", F.pmod(F.col("user_id") * 3 + F.col("tile"), F.lit(5)).alias("window")
    )


@query(f"""WITH {E}, {N}, w AS (SELECT user_id, n, unnest(range(0, n - 15, 8)) AS start FROM n WHERE n >= 16),
x AS (SELECT w.user_id, w.start, e.idx, e.v - f.v AS delta FROM w JOIN e ON e.user_id = w.user_id AND e.idx BETWEEN w.start AND w.start + 15 JOIN e f ON f.user_id = w.user_id AND f.idx = w.start)
SELECT count(*) AS n, round(quantile_cont(delta, 0.5), 6) AS center, round((quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25)) / 1.349, 6) AS scale FROM x""")
def sampled_window_stats(spark, d):
    """Robust statistics of displacements within windows, over all windows of all episodes."""
    windows = temporal.hop_windows(_lengths(spark, d), F.col("n"), F.lit(15), F.lit(8), tail=False)
    rows = temporal.window_features(windows, frames(spark, d), KEYS, 16, "v").select(F.lit("all").alias("scope"), "delta")
    n = rows.groupBy("scope").agg(F.count("*").alias("n"))
    return stats.robust(rows, ["scope"], "delta").join(n, "scope").select("n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query(f"""WITH {E}, n AS (SELECT event_id, user_id, idx, (lag(v, 1, v) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 50.0) / 20.0 AS act, k FROM e)
SELECT event_id, round(act, 6) AS act, round(k / 100.0 * 2 - 1, 6) AS video, 6 AS fps, 1 AS frame_stride, 0 AS start_idx, idx AS source_index FROM n""")
def adapter_rows(spark, d):
    """What a model is given for a frame: the command before it normalized, pixels from -1 to 1, and where it comes from."""
    rows = frames(spark, d)
    w = series.along(KEYS, ["idx"])
    act = stats.normalized(series.shifted(F.col("v"), w, F.col("v")), F.lit(50.0), F.lit(20.0))
    video = F.col("k") / 100.0 * 2 - 1
    fixed = [F.lit(6).alias("fps"), F.lit(1).alias("frame_stride"), F.lit(0).alias("start_idx")]
    return rows.select("event_id", F.round(act, 6).alias("act"), F.round(video, 6).alias("video"), *fixed, F.col("idx").alias("source_index"))


@query(f"""WITH {E}, {N}, a AS (SELECT user_id, list(idx // 2 * 2 ORDER BY idx) AS i, min(idx) AS s FROM e WHERE idx < 20 GROUP BY user_id)
SELECT user_id, true AS valid, false AS valid_from_two, false AS valid_backwards FROM a""")
def source_index_checks(spark, d):
    """Source indices that never go back and begin at their start; not so from another start, or backwards."""
    from quern.functions import checks

    places = F.array_sort(F.collect_list(F.expr("idx div 2 * 2")))
    rows = frames(spark, d).where("idx < 20").groupBy("user_id").agg(places.alias("i"), F.min("idx").alias("s"))
    i = F.col("i")
    made = {"valid": (i, F.col("s")), "valid_from_two": (i, F.col("s") + 2), "valid_backwards": (F.reverse(i), F.get(F.reverse(i), F.lit(0)))}
    return rows.select("user_id", *[checks.is_source_index(x, s).alias(n) for n, (x, s) in made.items()])


@query(f"""WITH {E}, w AS (SELECT user_id, 2 * i AS wanted, i FROM (SELECT DISTINCT user_id FROM e), range(0, 6) AS r(i)), j AS (SELECT w.user_id, i, e.event_id FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.idx = w.wanted)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS ids FROM j GROUP BY user_id""")
def selected_frames(spark, d):
    """Every other frame of the first eleven, from a table of decoded frames; one that is missing is an error."""
    windows = table(spark, d, "events").select("user_id").distinct().withColumn("indices", F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"), F.lit(2).cast("long")))
    rows = temporal.gather_all(windows.withColumn("start", F.lit(0)), frames(spark, d), ["user_id"], "indices", "event_id")
    return rows.select("user_id", _joined(F.col("values")).alias("ids"))
