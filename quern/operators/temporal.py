"""Windows over the frames of an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import series


def framed(rows: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Rows with their frame index, from 0, within their episode."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def feature_block(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Every column with its displacement from the first frame and its difference from the last."""
    w = series.along(keys, order)
    more = {}
    for c in columns:
        more[f"{c}_delta"] = series.displacement(F.col(c), w)
        more[f"{c}_velocity"] = series.velocity(F.col(c), w)
    return rows.withColumns(more)


def scaled_feature_block(rows: DataFrame, keys: list[str], order: list[str], column: str, center: Column, scale: Column, limit: float) -> DataFrame:
    """Normalized and clipped to [-1, 1]; then relative to the first frame and to the one before, clipped again."""
    w = series.along(keys, order)
    made = rows.withColumn("abs_scaled", series.clip((F.col(column) - center) / scale, -limit, limit) / limit)
    return made.withColumns(
        {
            "rel_scaled": series.clip(series.displacement(F.col("abs_scaled"), w), -1.0, 1.0),
            "delta_scaled": series.clip(series.velocity(F.col("abs_scaled"), w), -1.0, 1.0),
        }
    )


def hop_windows(lengths: DataFrame, length: Column, last_offset: Column, stride: Column, tail: bool = True) -> DataFrame:
    """A row for each window of each episode: ``start``."""
    return lengths.withColumn("start", F.explode(series.hop_starts(length, last_offset, stride, tail)))


def gather(windows: DataFrame, frames: DataFrame, keys: list[str], indices: str, values: list[str]) -> DataFrame:
    """The frames of every window in the order of its indices; ``at`` is the place in it."""
    wanted = windows.select("*", F.posexplode(indices).alias("at", "idx"))
    return wanted.join(frames.select(*keys, "idx", *values), [*keys, "idx"])


def previous_command(windows: DataFrame, frames: DataFrame, keys: list[str], start: Column, value: str) -> DataFrame:
    """For rows (keys, idx): the value one source frame earlier, but not before the window's start."""
    at = F.greatest(F.col("idx") - 1, start)
    source = frames.select(*keys, F.col("idx").alias("_at"), F.col(value).alias("previous"))
    return windows.withColumn("_at", at).join(source, [*keys, "_at"], "left").drop("_at")


def lagged_pairs(rows: DataFrame, keys: list[str], order: list[str], command: str, state: str, most: int) -> DataFrame:
    """Pairs of a frame's command and the state ``lag`` frames later, for each lag up to the most: (keys, lag, command, state)."""
    w = series.along(keys, order)
    states = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(state, k).over(w).alias("state")) for k in range(most + 1)])
    made = rows.select(*keys, F.col(command).alias("command"), states.alias("states"))
    return made.select(*keys, "command", F.inline("states")).where("state is not null")


def last_state(rows: DataFrame, keys: list[str], action: str, state: str, gain: float, bias: float) -> DataFrame:
    """(keys, n, state): the last of the states s[t] = s[t-1] + gain * (a[t-1] - s[t-1]) + bias, from the first frame's state, for rows (keys, idx).

    Each step is a straight line, so the last state is a sum over frames, each
    weighted by how far it lies back; no episode is gathered.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    back = F.pow(F.lit(1.0 - gain), F.col("n") - 2 - F.col("idx"))
    moved = F.when(F.col("idx") < F.col("n") - 1, back * (gain * F.col(action) + bias)).otherwise(0.0)
    start = F.when(F.col("idx") == 0, F.pow(F.lit(1.0 - gain), F.col("n") - 1) * F.col(state)).otherwise(0.0)
    return rows.join(sizes, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(moved + start).alias("state"))


def clipped_gather(windows: DataFrame, frames: DataFrame, keys: list[str], offsets: list[Column], length: str, values: list[str]) -> DataFrame:
    """The frames of windows (keys, start, length) at offsets from their start, held at the last frame: ``at``, ``clipped`` and the values."""
    wanted = windows.select("*", F.posexplode(F.array(*[F.col("start") + o for o in offsets])).alias("at", "_to"))
    last = F.col(length) - 1
    wanted = wanted.withColumn("clipped", F.col("_to") > last).withColumn("idx", F.least("_to", last)).drop("_to")
    return wanted.join(frames.select(*keys, "idx", *values), [*keys, "idx"])


def gather_all(windows: DataFrame, frames: DataFrame, keys: list[str], indices: str, value: str) -> DataFrame:
    """(keys, start, values): a list for each window, in the order of its indices, which must increase; a frame that isn't there raises an error."""
    steps = F.when(series.is_increasing(F.col(indices)), F.col(indices)).otherwise(F.raise_error(F.lit("indices do not increase")))
    wanted = windows.select(*keys, "start", F.posexplode(steps).alias("at", "idx"))
    found = frames.select(*keys, "idx", F.struct(F.col(value).alias("v")).alias("_f"))
    missing = F.raise_error(F.concat(F.lit("no frame "), F.col("idx").cast("string")))
    rows = wanted.join(found, [*keys, "idx"], "left").withColumn("_v", F.when(F.col("_f").isNull(), missing).otherwise(F.col("_f.v")))
    listed = F.array_sort(F.collect_list(F.struct("at", "_v")))
    return rows.groupBy(*keys, "start").agg(listed.alias("l")).select(*keys, "start", F.col("l._v").alias("values"))


def tiled(episodes: DataFrame, times: int) -> DataFrame:
    """Every episode as many times, numbered by ``tile``."""
    return episodes.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))


def window_features(windows: DataFrame, frames: DataFrame, keys: list[str], steps: int, value: str) -> DataFrame:
    """(keys, start, idx, delta): within each window, how far each frame's value lies from the first one's."""
    places = F.sequence(F.col("start"), F.col("start") + steps - 1)
    rows = gather(windows.withColumn("_places", places), frames, keys, "_places", [value])
    first = frames.select(*keys, F.col("idx").alias("start"), F.col(value).alias("_first"))
    return rows.join(first, [*keys, "start"]).select(*keys, "start", "idx", (F.col(value) - F.col("_first")).alias("delta"))
