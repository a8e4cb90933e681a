"""Manifest quality: duplicates, contradictions, exclusion reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import keys


def duplicate_groups(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, size, excess, canonical) of keys that more than one member has."""
    return (
        rows.groupBy(key)
        .agg(F.count("*").alias("size"), F.min(member).alias("canonical"))
        .where("size > 1")
        .withColumn("excess", F.col("size") - 1)
    )


def with_canonical(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Rows with the size and least member of their key.

    The sizes are joined back rather than taken over a window, so that they are
    summed before rows of a key come together.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("group_size"), F.min(member).alias("canonical"))
    return rows.join(sizes, key)


def contradictions(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, members, distinct_values) of keys whose members differ in these values."""
    return (
        rows.groupBy(key)
        .agg(F.count("*").alias("members"), F.count_distinct(*[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]).alias("distinct_values"))
        .where("distinct_values > 1")
    )


def reasons(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules that hold."""
    named = F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()])
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def issue_counts(rows: DataFrame, reasons_col: str) -> DataFrame:
    return rows.select(F.explode(reasons_col).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def excluded_groups(rows: DataFrame, group: str, conflict: Column, fraction: float) -> DataFrame:
    """Groups in which conflicts reach a fraction of the members, and there are any."""
    share = rows.groupBy(group).agg(F.avg(conflict.cast("double")).alias("share"))
    return share.where((F.col("share") >= fraction) & (F.col("share") > 0))


def short_episodes(rows: DataFrame, length: Column, required: Column, policy: str) -> DataFrame:
    """``filter`` drops short episodes, ``pad`` keeps them with a mark, ``error`` raises when one is met."""
    short = length < required
    if policy == "filter":
        return rows.where(~short)
    if policy == "pad":
        return rows.withColumn("is_padded", short)
    if policy == "error":
        return rows.withColumn("is_padded", F.when(short, F.raise_error(F.lit("episode is too short"))).otherwise(F.lit(False)))
    raise ValueError(f"unknown policy {policy!r}")


def exact_file_groups(files: DataFrame, kind: str = "file") -> DataFrame:
    """(group_id, sha256, bytes_each, size, canonical_member) of files (path, length, content) with equal bytes.

    Contents are hashed only where lengths are equal, and digests are counted
    before rows of a group come together; members are the files of a digest.
    """
    alike = files.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    hashed = files.join(alike, "length", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256"))
    groups = hashed.groupBy("length", "sha256").agg(F.count("*").alias("size"), F.min("path").alias("canonical_member")).where("size > 1")
    name = F.concat(F.lit(f"{kind}:"), F.substring("sha256", 1, 20))
    return groups.select(name.alias("group_id"), "sha256", F.col("length").alias("bytes_each"), "size", "canonical_member")


def vector_audit(rows: DataFrame, by: list[str], index: str, vector: str) -> DataFrame:
    """For each group and dimension of its vectors: n, least, most, mean, std, finite, and whether indices are there once.

    Indices are compared once a group, not once a dimension: up to the width of
    the second widest vector of an index, or of any without one, each
    dimension has an index twice.
    """
    long = rows.select(*by, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    sums = long.groupBy(*by, "dim").agg(
        F.count("*").alias("n"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.every(finite).alias("finite"),
    )
    nth = F.row_number().over(Window.partitionBy(*by, index).orderBy(F.desc("_width")))
    widths = rows.select(*by, index, F.size(vector).alias("_width")).withColumn("_nth", nth)
    again = widths.where((F.col("_nth") == 2) | F.col(index).isNull()).groupBy(*[F.col(b).alias(f"_by_{b}") for b in by])
    own = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.lit(True))
    met = sums.join(again.agg(F.max("_width").alias("_twice")), own, "left").drop(*[f"_by_{b}" for b in by])
    return met.withColumn("unique_index", F.col("dim") >= F.coalesce("_twice", F.lit(0))).drop("_twice")


def tree_digests(files: DataFrame, by: list[str], order: str, name: str, content: str) -> DataFrame:
    """(by, digest) over the files of each group in order: name and content, each behind its length; a group is a folder of sources."""
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(name).cast("binary").alias("n"), F.col(content).cast("binary").alias("c"))))
    put = lambda acc, x: F.concat(acc, keys.length_prefixed(x["n"]), keys.length_prefixed(x["c"]))
    return files.groupBy(*by).agg(listed.alias("f")).select(*by, F.sha2(F.aggregate("f", F.lit(b""), put), 256).alias("digest"))


def contiguous(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Whether each key's index is 0 to n - 1, each once."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (
            (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))
        ).alias("contiguous"),
    )


def contiguous_in_order(rows: DataFrame, keys: list[str], index: str, order: list[str]) -> DataFrame:
    """As :func:`contiguous`, in the order that the rows were stored in."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("at", at).groupBy(*keys).agg(F.count("*").alias("n"), F.every(F.col(index) == F.col("at")).alias("contiguous"))
