"""Queries on clips of frames: vectors as clips of four frames of four by four pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import series
from quern.operators import clips, frames
from quern.plans.registry import query
from quern.tables import table

SHAPE = (4, 1, 4, 4)
#: Each clip's target is the next vector by id, the last one's its own.
CLIPS = """c AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS p, coalesce(b.embedding, a.embedding)::DOUBLE[] AS t
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _clips(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("prediction"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("prediction").alias("target"))
    return rows.join(after, "vec_id", "left").withColumn("target", F.coalesce("target", "prediction"))


@query(f"""WITH {CLIPS} SELECT vec_id, round(list_sum([abs(p[i] - t[i]) FOR i IN range(1, 65)]) / 64, 6) AS l1,
  round(list_sum([abs(p[i] - t[i]) FOR i IN range(1, 17)]) / 16, 6) AS first_frame_l1,
  round(list_sum([abs((p[i] - p[i - 16]) - (t[i] - t[i - 16])) FOR i IN range(17, 65)]) / 48, 6) AS temporal_l1,
  round(abs(list_sum([abs(p[i] - p[i - 16]) FOR i IN range(17, 65)]) - list_sum([abs(t[i] - t[i - 16]) FOR i IN range(17, 65)])) / 48, 6) AS motion_amplitude_error,
  round(-10 * log10(greatest(list_sum([(p[i] - t[i]) * (p[i] - t[i]) FOR i IN range(1, 65)]) / 64, 1e-12)), 4) AS psnr,
  len([i FOR i IN range(17, 65) IF abs(t[i] - t[(i - 1) % 16 + 1]) > 0.1]) / 64.0::DOUBLE AS moving_fraction FROM c""")
def clip_metrics(spark, d):
    out = clips.reconstruction_metrics(_clips(spark, d), SHAPE, id_col="vec_id", threshold=0.1, dilation=1)
    names = ("l1", "first_frame_l1", "temporal_l1", "motion_amplitude_error")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in names], F.round("psnr", 4).alias("psnr"), "moving_fraction")


@query()
def ssim_metrics(spark, d):
    """Structure, edges, foreground and the loss of all clips; held against plain loops in the tests."""
    return clips.reconstruction_metrics(_clips(spark, d), SHAPE, id_col="vec_id", threshold=0.1, dilation=3)


@query("""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS t FROM embeddings),
m AS (SELECT vec_id, i // 16 AS f, i % 16 // 4 AS y, i % 4 AS x, i >= 16 AND abs(t[i + 1] - t[i % 16 + 1]) > 0.15 AS hit FROM c, range(0, 64) AS r(i)),
o AS (SELECT a.vec_id, a.f * 16 + a.y * 4 + a.x AS i, bool_or(b.hit) AS hit FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.f = b.f AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT vec_id, string_agg(hit::INT::VARCHAR, '' ORDER BY i) AS mask FROM o GROUP BY vec_id""")
def motion_mask(spark, d):
    """Pixels that differ from the first frame, and those beside them."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("frames"))
    out = clips.motion_masks(rows, SHAPE, id_col="vec_id", threshold=0.15, dilation=3)
    return out.select("vec_id", F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"))


@query()
def action_content_hash(spark, d):
    """Digests of vectors as matrices of eight columns: shape and values as little-endian bytes."""
    return clips.content_hashes(table(spark, d, "embeddings"), 8, id_col="vec_id", values="embedding")


@query(f"""WITH {CLIPS}, e AS (SELECT vec_id, list_sum([abs(p[i] - t[i]) * 127.5 FOR i IN range(1, 65)]) / 64 AS mae,
  list_sum([(p[i] - t[i]) * (p[i] - t[i]) * 16256.25 FOR i IN range(1, 65)]) / 64 AS mse FROM c)
SELECT vec_id, round(mae, 4) AS mae, round(CASE WHEN mse = 0 THEN 100 ELSE least(100, 10 * log10(65025 / mse)) END, 4) AS psnr,
  mae <= 15 AND CASE WHEN mse = 0 THEN 100 ELSE least(100, 10 * log10(65025 / mse)) END >= 20 AS same FROM e""")
def first_frame_gate(spark, d):
    """The gate on first frames, over vectors scaled to 8-bit values."""
    to_bytes = lambda c: F.transform(c, lambda x: (x + 1) * 127.5)
    rows = _clips(spark, d).select("vec_id", to_bytes("prediction").alias("a"), to_bytes("target").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "vec_id",
        F.round(frames.l1(a, b), 4).alias("mae"),
        F.round(frames.psnr(a, b, 255.0), 4).alias("psnr"),
        frames.is_same_first_frame(a, b, 15.0, 20.0).alias("same"),
    )


@query(f"""WITH {CLIPS}, s AS (SELECT vec_id, [CASE WHEN abs(e) < 0.1 THEN 5 * e * e ELSE abs(e) - 0.05 END FOR e IN [p[i] - t[i] FOR i IN range(1, 65)]] AS err,
  [CASE WHEN abs(e) < 0.1 THEN 5 * e * e ELSE abs(e) - 0.05 END FOR e IN [(p[i] - p[i - 16]) - (t[i] - t[i - 16]) FOR i IN range(17, 65)]] AS vel FROM c),
u AS (SELECT vec_id, list_sum(err[1:16]) / 16 AS initial, list_sum(err[17:64]) / 48 AS rollout, list_sum(vel) / 48 AS velocity FROM s)
SELECT vec_id, round(initial, 6) AS initial, round(rollout, 6) AS rollout, round(velocity, 6) AS velocity, round(initial + rollout + 0.25 * velocity, 6) AS total FROM u""")
def state_loss(spark, d):
    """Smooth errors of the first state, of the others, and of their differences: four states of sixteen values."""
    parts = series.state_losses(F.col("prediction"), F.col("target"), 4, 16, beta=0.1)
    return _clips(spark, d).select("vec_id", *[F.round(x, 6).alias(n) for n, x in parts.items()])


@query("""WITH s AS (SELECT p_partkey, (p_size * 16)::DOUBLE AS w, (p_partkey % 37 + 8)::DOUBLE * 8 AS h FROM part),
f AS (SELECT *, least(320.0::DOUBLE / w, 256.0::DOUBLE / h) AS k FROM s),
g AS (SELECT p_partkey, greatest(floor(w * k + 0.5), 1)::INT AS w, greatest(floor(h * k + 0.5), 1)::INT AS h FROM f)
SELECT p_partkey, w, h, floor((320 - w) / 2)::INT AS "left", floor((256 - h) / 2)::INT AS top, w * h AS picture, 320 * 256 - w * h AS padding FROM g""")
def letterbox_half_up(spark, d):
    size = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 16).cast("double").alias("fw"), ((F.col("p_partkey") % 37 + 8) * 8).cast("double").alias("fh")
    )
    made = size.select("p_partkey", *[x.alias(n) for n, x in frames.letterbox(F.col("fw"), F.col("fh"), 320, 256, half_up=True).items()])
    picture = F.col("w") * F.col("h")
    return made.select("*", picture.alias("picture"), (F.lit(320 * 256) - picture).alias("padding"))


@query()
def letterbox_pixels(spark, d):
    """Frames of eight by eight pixels fitted into a box of four by sixteen, and restored; held against plain loops in the tests."""
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    return clips.fitted(rows, (4, 16), id_col="vec_id", back=True)
