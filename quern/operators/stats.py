"""Statistics of series, and normalization by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sampling import numbered


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sufficient(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Count, sums, ends, mean and deviation of the finite values; the variance is not below 0."""
    sums = rows.where(finite(F.col(x))).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("total"),
        F.sum(F.col(x) * F.col(x)).alias("squares"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
    )
    mean = F.col("total") / F.col("n")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))))


def gaussian(rows: DataFrame, by: list[str], x: str, min_std: float) -> DataFrame:
    stats = sufficient(rows, by, x)
    return stats.select(*by, "n", "mean", F.greatest("std", F.lit(min_std)).alias("std"))


def quartiles(x: str) -> list[Column]:
    """For groups that fit in a task."""
    p = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [p[0].alias("q1"), p[1].alias("median"), p[2].alias("q3")]


def quantiles(rows: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles between neighbours, picked by their ranks.

    Values are sorted by ranges, so a group of any size is dealt to many tasks;
    nulls are passed over.
    """
    placed = numbered(rows.where(F.col(x).isNotNull()).select(*by, x), [*by, x], "_rn")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_rn").alias("_first"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), (F.lit(p) * (F.col("_n") - 1)).alias("_at")) for name, p in shares.items()])
    share = F.col("_at") - F.floor("_at")
    both = F.array(F.struct(F.lit(0).alias("_up"), (1 - share).alias("_w")), F.struct(F.lit(1).alias("_up"), share.alias("_w")))
    picks = sizes.select("_first", F.inline(wanted)).select("_name", "_at", "_first", F.inline(both)).where("_w > 0")
    picks = picks.select("_name", "_w", (F.col("_first") + F.floor("_at") + F.col("_up")).alias("_rn"))
    found = placed.join(picks, "_rn")
    value = F.col("_w") * F.col(x)
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("_name") == name, value)).alias(name) for name in shares])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def robust(rows: DataFrame, by: list[str], x: str, eps: float = 1e-4) -> DataFrame:
    """Median and a scale: the interquartile range over 1.349, or the deviation where that is too small."""
    stats = quantiles(rows, by, x, QUARTILES).join(rows.groupBy(*by).agg(F.stddev_pop(x).alias("std")), by)
    scale = (F.col("q3") - F.col("q1")) / 1.349
    return stats.select(*by, F.col("median").alias("center"), F.when(scale <= eps, F.greatest("std", F.lit(eps))).otherwise(scale).alias("scale"))


def robust_without_last(rows: DataFrame, episode: list[str], order: list[str], by: list[str], x: str, eps: float = 1e-6) -> DataFrame:
    """Median and interquartile range of all frames but the last of each episode; the scale is 1 where it is too small."""
    after = F.lead(F.lit(1)).over(Window.partitionBy(*episode).orderBy(*order))
    kept = rows.withColumn("_after", after).where("_after is not null")
    stats = kept.groupBy(*by).agg(F.count("*").alias("n"), *quartiles(x))
    iqr = F.col("q3") - F.col("q1")
    return stats.select(*by, "n", "median", iqr.alias("iqr"), F.when(iqr >= eps, iqr).otherwise(1.0).alias("scale"))


def normalized(x: Column, center: Column, scale: Column, limit: float | None = None) -> Column:
    z = (x - center) / scale
    return z if limit is None else F.least(F.greatest(z, F.lit(-limit)), F.lit(limit))


def standardized(values: Column, center: Column, scale: Column) -> Column:
    """Arrays normalized element by element, without a limit."""
    parts = F.arrays_zip(values.alias("x"), center.alias("c"), scale.alias("s"))
    return F.transform(parts, lambda p: (p["x"] - p["c"]) / p["s"])


def identity_stats(width: int) -> tuple[Column, Column]:
    """A center and a scale that leave vectors of this width as they are."""
    return F.array_repeat(F.lit(0.0).cast("double"), width), F.array_repeat(F.lit(1.0).cast("double"), width)


def reparameterized(weight: Column, bias: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> tuple[Column, Column]:
    """(weights, bias) of a line over inputs normalized by ``new``, equal to one over inputs normalized by ``old``; each is (center, scale)."""
    w = F.transform(F.arrays_zip(weight.alias("w"), new[1].alias("t"), old[1].alias("s")), lambda p: p["w"] * p["t"] / p["s"])
    moved = F.arrays_zip(weight.alias("w"), new[0].alias("t"), old[0].alias("c"), old[1].alias("s"))
    return w, F.aggregate(moved, bias, lambda acc, p: acc + p["w"] * (p["t"] - p["c"]) / p["s"])


def bound(stats: DataFrame, signature: Column, name: str = "signature") -> DataFrame:
    """Statistics that were made for this split; those of another raise an error."""
    other = F.raise_error(F.lit("statistics belong to another split"))
    return stats.withColumn(name, F.when(F.col(name) == signature, F.col(name)).otherwise(other))


def restored(z: Column, center: Column, scale: Column) -> Column:
    return z * scale + center


def errors(by: list, command: str = "command", state: str = "state") -> list[Column]:
    """Aggregates: count, mean absolute and root mean square error, and correlation by sums with its variances clamped."""
    c, s = F.col(command), F.col(state)
    n = F.count("*")
    cov = F.sum(c * s) / n - F.sum(c) / n * (F.sum(s) / n)
    var = lambda x: F.greatest(F.sum(x * x) / n - (F.sum(x) / n) * (F.sum(x) / n), F.lit(1e-24))
    e = s - c
    return [
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (cov / F.sqrt(var(c) * var(s))).alias("corr"),
    ]


def close(a: Column, b: Column, rel: float = 1e-10, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))
