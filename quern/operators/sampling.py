"""Ordering and sampling: global numbers, round-robin selection, ring donors, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import keys
from quern.storage import checkpointed


def numbered(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """Rows with their place, from 1, in a total order. No task sees more than a range of them.

    Rows are sorted by ranges and kept; each range counts its own, and starts
    after what the ranges before it have.
    """
    order = [order] if isinstance(order, str) else order
    ranges = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, "_range").withColumn(name, number.cast("long")).drop("_at", "_range", "_before")


def numbered_in_groups(rows: DataFrame, by: list[str], order: list[str], name: str, size: str) -> DataFrame:
    """Rows with their place in their group, from 1, and the group's size. A group of any size is dealt to as many tasks as it needs."""
    placed = numbered(rows, [*by, *order], "_rn")
    sizes = placed.groupBy(*by).agg(F.count("*").alias(size), F.min("_rn").alias("_first"))
    own = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.lit(True))
    sizes = sizes.select(*[F.col(b).alias(f"_by_{b}") for b in by], size, "_first")
    joined = placed.join(sizes, own).drop(*[f"_by_{b}" for b in by])
    return joined.withColumn(name, F.col("_rn") - F.col("_first") + 1).drop("_rn", "_first")


def round_robin(rows: DataFrame, group: str, seed: str, line: Column, tie: str, limit: int) -> DataFrame:
    """The first ``limit`` rows when groups take turns, groups and rows each in the order of their seeded scores."""
    own = Window.partitionBy(group).orderBy("_score", tie)
    placed = (
        rows.withColumn("_score", keys.score_hex(seed, line))
        .withColumn("depth", F.row_number().over(own) - 1)
        .where(F.col("depth") < limit)
        .withColumn("group_score", keys.score_hex(seed, F.col(group)))
    )
    return placed.drop("_score").orderBy("depth", "group_score", group).limit(limit)


def ring_donor(rows: DataFrame, order: list[str], donor: str, name: str) -> DataFrame:
    """Every row with the ``donor`` column of the next row in a total order; the last takes the first's."""
    placed = numbered(rows, order, "_rn")
    n = placed.agg(F.count("*").alias("_n"))
    nexts = placed.select((F.col("_rn") - 1).alias("_rn"), F.col(donor).alias(name))
    wanted = placed.join(F.broadcast(n)).withColumn("_to", F.col("_rn") % F.col("_n"))
    return wanted.join(nexts.withColumnRenamed("_rn", "_to"), "_to").drop("_to", "_rn", "_n")


def frequency_weight(rows: DataFrame, owner: str, exponent: float) -> DataFrame:
    """Each row with its owner's count to the power of ``-exponent``; counts are summed before they are joined back."""
    counts = rows.groupBy(owner).agg(F.count("*").alias("owner_n"))
    return rows.join(counts, owner).withColumn("weight", F.pow(F.col("owner_n").cast("double"), F.lit(-exponent)))


def weighted_draws(rows: DataFrame, key: str, weight: Column, draws: int, seed: str, epoch: int, parts: int = 1024) -> DataFrame:
    """``draws`` rows with replacement in proportion to weights: (draw, key).

    Rows lie on a line, each as long as its weight, in the order of numbers;
    a draw is a hashed point on it. The line is cut into parts, and points
    and rows meet in the parts that they touch. Deterministic for a seed and
    epoch, but not the numbers of any other generator.
    """
    spark = rows.sparkSession
    placed = numbered(rows.select(F.col(key).alias("key"), weight.cast("double").alias("w")), "key", "rn")
    block = F.floor((F.col("rn") - 1) / 4096)
    blocks = placed.groupBy(block.alias("block")).agg(F.sum("w").alias("bw"))
    before = F.sum("bw").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("block", F.coalesce(before, F.lit(0.0)).alias("b0"))
    within = F.sum("w").over(Window.partitionBy("block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    spans = placed.withColumn("block", block).join(starts, "block").withColumn("hi", F.col("b0") + within).withColumn("lo", F.col("hi") - F.col("w"))
    total = blocks.agg(F.sum("bw").alias("total"))
    spans = spans.join(F.broadcast(total))
    part = lambda x: F.least(F.floor(x / F.col("total") * parts), F.lit(parts - 1))
    spans = spans.select("key", "lo", "hi", F.explode(F.sequence(part(F.col("lo")), part(F.col("hi")))).alias("part"))
    u = F.conv(keys.score_hex(f"{seed}:{epoch}", F.col("id").cast("string")), 16, 10).cast("double") / F.lit(float(2**64))
    points = spark.range(draws).join(F.broadcast(total)).select(F.col("id").alias("draw"), (u * F.col("total")).alias("x"), part(u * F.col("total")).alias("part"))
    return points.join(spans, "part").where("lo <= x and x < hi").select("draw", "key")
