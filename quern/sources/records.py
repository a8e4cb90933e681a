"""Tables that are checked as they are read: frames of episodes, manifests, folds, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import checks
from quern.operators.evaluate import assertions, require_all

MANIFEST = (
    "schema_version int, episode_key string, repository_id string, owner string, validation_group string, "
    "length long, include_for_training boolean, reasons array<string>"
)


def vector_fault(values: Column, width: int | None = None) -> Column:
    """What is wrong with a vector: ``null``, ``empty``, ``width`` or ``not_finite``; null if nothing is."""
    fault = F.when(values.isNull(), "null").when(F.size(values) == 0, "empty")
    if width is not None:
        fault = fault.when(F.size(values) != width, "width")
    return fault.when(~checks.is_finite_vector(values), "not_finite")


def checked(values: Column, width: int | None = None) -> Column:
    """The vector itself; one with a fault raises an error."""
    fault = vector_fault(values, width)
    return F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("bad vector: "), fault))).otherwise(values)


def renamed(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """One schema from several: each wanted column from the first of its names that the rows have; an error if they have none."""
    found = {}
    for wanted, others in names.items():
        have = [n for n in (wanted, *others) if n in rows.columns]
        if not have:
            raise ValueError(f"no column for {wanted!r} among {rows.columns}")
        found[wanted] = have[0]
    return rows.select(*[F.col(f"`{n}`").alias(w) for w, n in found.items()])


def frames(
    spark: SparkSession, paths: str | list[str], *, width: int | None = None, with_state: bool = False, optional: tuple[str, ...] = ()
) -> DataFrame:
    """(path, at, action[, state], optional columns) of frame tables: one row for each frame, ``at`` its place in the file.

    Only these columns are read. Every vector must be finite, not empty and,
    if it is told, of this width; others raise an error. Optional columns that
    the files lack are null.
    """
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    state = ["observation.state"] if with_state else []
    lacking = [c for c in ("action", *state) if c not in rows.columns]
    if lacking:
        raise ValueError(f"frame tables lack {lacking}")
    vectors = {"action": "action", "observation.state": "state"}
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("at"),
        *[checked(F.col(f"`{c}`").cast("array<double>"), width).alias(vectors[c]) for c in ("action", *state)],
        *[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("long").alias(c) for c in optional],
    )


def parsed(lines: DataFrame, schema: str = MANIFEST, required: tuple[str, ...] = ("episode_key",), default: bool = True) -> DataFrame:
    """Records of JSON lines (value) with ``included``: the flag, or the default where there is none.

    Blank lines are passed over. A line that is no JSON object of this schema,
    a required field that is missing or empty, and a negative length raise an
    error.
    """
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    for name in required:
        given = F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
        rows = rows.withColumn(name, F.when(given, F.col(name)).otherwise(F.raise_error(F.lit(f"a record lacks {name}"))))
    if "length" in rows.columns:
        rows = rows.withColumn("length", F.when(F.col("length") < 0, F.raise_error(F.lit("negative length"))).otherwise(F.col("length")))
    return rows.withColumn("included", checks.is_included(F.col("include_for_training"), default))


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows as they are; an error if a key is there twice."""
    require_all(assertions({f"repeated {key}": rows.groupBy(key).count().where("count > 1")}))
    return rows


def manifest(spark: SparkSession, path: str, default: bool = True) -> DataFrame:
    """The records of a manifest of JSON lines, each key once, and at least one included."""
    rows = require_unique(parsed(spark.read.text(path), default=default), "episode_key")
    if rows.where("included").isEmpty():
        raise ValueError("a manifest has no included episode")
    return rows


def manifest_snapshot(rows: DataFrame) -> DataFrame:
    """(total, included, excluded, schema_versions) of a manifest's records; versions are few."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("included")).alias("included"),
        F.count_if(~F.col("included")).alias("excluded"),
        F.array_sort(F.collect_set(F.coalesce("schema_version", F.lit(0)))).alias("schema_versions"),
    )


def stats(spark: SparkSession, path: str) -> DataFrame:
    """(center, scale) of a JSON artifact of robust statistics; ``iqr`` stands in for a scale that is not given.

    Both must be finite vectors of one width, and scales positive.
    """
    rows = spark.read.schema("center array<double>, scale array<double>, iqr array<double>").json(path)
    rows = rows.select("center", F.coalesce("scale", "iqr").alias("scale"))
    fits = checks.is_stats(F.col("center"), F.col("scale"))
    bad = F.raise_error(F.lit("statistics are not finite, positive and of one width"))
    return rows.select("center", F.when(fits, F.col("scale")).otherwise(bad).alias("scale"))


def inventory_rules(found: DataFrame, expected: DataFrame, root: str, name: str = "path") -> dict[str, DataFrame]:
    """What keeps a listing (path) from being exactly the expected names, by rule: nested, missing, extra."""
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root.rstrip('/')}/", "")
    names = found.select(inside.alias(name))
    return {
        "nested": names.where(F.col(name).contains("/")),
        "missing": expected.select(name).join(names, name, "left_anti"),
        "extra": names.join(expected.select(name), name, "left_anti"),
    }
