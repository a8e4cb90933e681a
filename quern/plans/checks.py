"""Queries on record checks, frames as arrays, windows of event time and file layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import checks, keys
from quern.operators import frames
from quern.plans.registry import query
from quern.sources import outputs
from quern.streaming.events import windowed
from quern.tables import table


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most
FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    out = windowed(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")
    return out.withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT p_partkey, (p_size * 16)::DOUBLE AS w, (p_partkey % 37 + 8)::DOUBLE * 8 AS h FROM part),
f AS (SELECT *, least(320.0::DOUBLE / w, 256.0::DOUBLE / h) AS k FROM s),
g AS (SELECT p_partkey, greatest(round_even(w * k, 0), 1)::INT AS w, greatest(round_even(h * k, 0), 1)::INT AS h FROM f)
SELECT p_partkey, w, h, floor((320 - w) / 2)::INT AS "left", floor((256 - h) / 2)::INT AS top FROM g""")
def letterbox_geometry(spark, d):
    size = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 16).cast("double").alias("fw"), ((F.col("p_partkey") % 37 + 8) * 8).cast("double").alias("fh")
    )
    return size.select("p_partkey", *[x.alias(n) for n, x in frames.letterbox(F.col("fw"), F.col("fh"), 320, 256).items()])


@query("""WITH c AS (SELECT label, vec_id, embedding::DOUBLE[] AS a FROM embeddings),
f AS (SELECT label, arg_min(a, vec_id) AS b FROM c GROUP BY label),
m AS (SELECT vec_id, list_sum([abs(a[i] - b[i]) FOR i IN range(1, 65)]) / 64 AS l1, list_sum([(a[i] - b[i]) * (a[i] - b[i]) FOR i IN range(1, 65)]) / 64 AS mse,
  len([i FOR i IN range(1, 65) IF abs(a[i] - b[i]) > 0.1]) AS moving FROM c JOIN f USING (label))
SELECT vec_id, round(l1, 6) AS l1, round(CASE WHEN mse = 0 THEN 100 ELSE least(100, 10 * log10(1 / mse)) END, 4) AS psnr, moving::INT AS moving FROM m""")
def frame_metrics(spark, d):
    """Vectors as frames, each against the first of its label."""
    rows = table(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    a, b = F.col("embedding"), F.col("first")
    moving = F.size(F.filter(frames.motion_mask(a, b, 0.1), lambda x: x))
    return rows.join(first, "label").select(
        "vec_id", F.round(frames.l1(a, b), 6).alias("l1"), F.round(frames.psnr(a, b), 4).alias("psnr"), moving.alias("moving")
    )


@query("""SELECT vec_id, len(embedding) = 64 AND list_bool_and([isfinite(x) FOR x IN embedding]) AS finite, embedding[1] >= 0 AS from_zero FROM embeddings""")
def vector_checks(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", checks.is_finite_vector(e, 64).alias("finite"), (e[0] >= 0).alias("from_zero"))


@query("""SELECT page_id, NOT list_has_any(string_split(lower(url), '/'), ['..', 'docs']) AND NOT starts_with(url, '/') AS safe FROM pages""")
def path_safety(spark, d):
    return table(spark, d, "pages").select("page_id", checks.is_safe_path(F.col("url"), ("docs",)).alias("safe"))


@query("""SELECT n_nationkey, substr(sha1(n_name), 1, 16) AS cache_key, row_number() OVER (ORDER BY n_nationkey DESC) <= 3 OR n_nationkey % 10 = 0 AS keep FROM nation""")
def checkpoint_retention(spark, d):
    out = outputs.retained(table(spark, d, "nation"), "n_nationkey", 3, 10)
    return out.select("n_nationkey", keys.cache_key(F.col("n_name")).alias("cache_key"), "keep")
