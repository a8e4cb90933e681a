"""Collections of episodes on disk: ``owner/dataset/meta/info.json`` and ``meta/episodes.jsonl`` beside frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<dtype:string,shape:array<int>,info:map<string,double>>"
INFO = f"fps double, chunks_size long, data_path string, video_path string, features map<string,{FEATURE}>"
#: Cameras that are not eligible, by a part of their name.
CLOSE_CAMERAS = "wrist|gripper|arm"


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*[F.nullif(v.cast("double"), F.lit(0.0)) for v in values])


def path_of(template: Column, chunk: Column, index: Column, camera: Column) -> Column:
    """A path template with its chunk, index and camera put in."""
    made = F.replace(template, F.lit("{episode_chunk:03d}"), F.format_string("%03d", chunk))
    made = F.replace(made, F.lit("{episode_index:06d}"), F.format_string("%06d", index))
    return F.replace(made, F.lit("{video_key}"), F.coalesce(camera, F.lit("")))


def is_wide_camera(name: Column) -> Column:
    return ~F.lower(F.regexp_replace(name, r"^observation\.(images\.)?", "")).rlike(CLOSE_CAMERAS)


def repositories(spark: SparkSession, root: str) -> DataFrame:
    """(repository_id, owner, fps, chunks_size, data_path, video_path, video_key, action_dim), those with actions and a camera.

    An action that is no vector is an error. The least eligible camera is taken.
    """
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/meta/info.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.concat_ws("/", F.element_at(parts, -4), F.element_at(parts, -3))
    info = files.select(name.alias("repository_id"), F.from_json("value", INFO, {"mode": "FAILFAST"}).alias("i"))
    features = F.col("i.features")
    videos = F.filter(F.map_keys(features), lambda k: (features[k]["dtype"] == "video") & is_wide_camera(k))
    video = F.array_min(videos)
    shape = features["action"]["shape"]
    width = F.when(F.size(shape) == 1, shape[0]).otherwise(F.raise_error(F.concat(F.lit("action is no vector: "), F.col("repository_id"))))
    return info.where(features["action"].isNotNull() & video.isNotNull()).select(
        "repository_id",
        F.split_part("repository_id", F.lit("/"), F.lit(1)).alias("owner"),
        first_set(features[video]["info"]["video.fps"], F.col("i.fps"), F.lit(6.0)).alias("fps"),
        F.coalesce("i.chunks_size", F.lit(1000)).alias("chunks_size"),
        "i.data_path",
        "i.video_path",
        video.alias("video_key"),
        width.alias("action_dim"),
    )


def episodes(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """A row for each episode that the metadata lists, with its key and paths; indices may have gaps, blank lines are passed over.

    Episodes of a collection without actions or an eligible camera are passed
    over; with ``strict`` they are an error.
    """
    lines = spark.read.schema("episode_index long, length long, tasks array<string>").json(f"{root}/*/*/meta/episodes.jsonl")
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = lines.withColumn("repository_id", F.concat_ws("/", F.element_at(parts, -4), F.element_at(parts, -3)))
    found = rows.where("episode_index is not null").join(repositories(spark, root), "repository_id", "left" if strict else "inner")
    if strict:
        error = F.raise_error(F.concat(F.lit("no actions or no eligible camera: "), F.col("repository_id")))
        found = found.withColumn("video_key", F.when(F.col("video_key").isNull(), error).otherwise(F.col("video_key")))
    index = F.col("episode_index")
    chunk = F.expr("episode_index div chunks_size")
    return found.select(
        F.format_string("%s/episode_%06d", F.col("repository_id"), index).alias("episode_key"),
        "repository_id",
        "owner",
        "episode_index",
        "length",
        "tasks",
        "fps",
        "video_key",
        path_of(F.col("data_path"), chunk, index, F.col("video_key")).alias("parquet_path"),
        path_of(F.col("video_path"), chunk, index, F.col("video_key")).alias("video_path"),
    )


def camera_examples(spark: SparkSession, root: str, width: int = 6, least_length: int = 1) -> DataFrame:
    """(repository_id, video_key, episode_index, length): a row for each eligible camera and episode.

    Of collections whose action is a vector of this width alone, and of
    episodes of this length at least.
    """
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/meta/info.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.concat_ws("/", F.element_at(parts, -4), F.element_at(parts, -3)).alias("repository_id")
    info = files.select(name, F.from_json("value", INFO, {"mode": "FAILFAST"}).alias("i"))
    features = F.col("i.features")
    cameras = F.filter(F.map_keys(features), lambda k: (features[k]["dtype"] == "video") & is_wide_camera(k))
    wide = info.where(features["action"]["shape"] == F.array(F.lit(width))).select(
        "repository_id", F.explode(F.array_sort(cameras)).alias("video_key")
    )
    lines = spark.read.schema("episode_index long, length long").json(f"{root}/*/*/meta/episodes.jsonl")
    rows = lines.where("episode_index is not null").select(name, "episode_index", "length")
    return wide.join(rows.where(F.col("length") >= least_length), "repository_id")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("bytes"))


def file_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(paths)
    return records(files.select("path", "content"))


def records(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of (path, content)."""
    content = F.col("content").cast("binary")
    return files.select("path", F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of records (path, bytes, sha256): ok, missing, extra, other_size or other_content."""
    a = expected.select("path", F.struct("bytes", "sha256").alias("a"))
    b = found.select("path", F.struct("bytes", "sha256").alias("b"))
    status = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("a").isNull(), "extra")
        .when(F.col("a.bytes") != F.col("b.bytes"), "other_size")
        .when(F.col("a.sha256") != F.col("b.sha256"), "other_content")
        .otherwise("ok")
    )
    return a.join(b, "path", "full").select("path", status.alias("status"))


def paired_by_stem(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stem, a_path, b_path) of two listings (path) of files with the same stem; one without the other is an error."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    x, y = a.select(stem.alias("stem"), F.col("path").alias("a_path")), b.select(stem.alias("stem"), F.col("path").alias("b_path"))
    both = x.join(y, "stem", "full")
    alone = F.col("a_path").isNull() | F.col("b_path").isNull()
    return both.withColumn("a_path", F.when(alone, F.raise_error(F.concat(F.lit("without its pair: "), F.col("stem")))).otherwise(F.col("a_path")))
