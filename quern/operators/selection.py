"""Selection of candidates: gates composed into one plan, ranks, and the same selection made again from its sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import evaluate
from quern.operators.quality import reasons
from quern.operators.stats import quantiles


@dataclass(frozen=True)
class Policy:
    """What a candidate must reach. A mean must be above its minimum, a fraction may equal it."""

    least_mean_delta: float = 0.0
    least_positive: float = 0.5
    wanted: int = 216
    reserve: float = 300.0
    factor: float = 1.25
    limit: float = 3600.0
    least_samples: int = 8

    def __post_init__(self) -> None:
        if not 0 <= self.least_positive <= 1 or self.least_mean_delta < 0 or self.factor < 1 or not 0 <= self.limit <= 3600:
            raise ValueError("a policy's minimum, factor or limit is out of bounds")


def sensitivity(pairs: DataFrame, by: list[str], original: str, control: str, least: float = 0.0) -> DataFrame:
    """(by, n, mean, median, positive, gate) of control - original; values that aren't finite raise an error.

    The gate is passed by a mean above ``least``. Medians are picked by rank,
    so no group's values come together.
    """
    delta = F.col(control).cast("double") - F.col(original).cast("double")
    usable = delta.isNotNull() & ~F.isnan(delta) & (F.abs(delta) != float("inf"))
    rows = pairs.select(*by, F.when(usable, delta).otherwise(F.raise_error(F.lit("a difference is not finite"))).alias("delta"))
    means = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("delta").alias("mean"),
        F.avg((F.col("delta") > 0).cast("double")).alias("positive"),
    )
    middle = quantiles(rows, by, "delta", {"median": 0.5})
    joined = means.join(middle, by) if by else means.crossJoin(middle)
    return joined.select(*by, "n", "mean", "median", "positive", (F.col("mean") > least).alias("gate"))


def select(sensitivities: DataFrame, runtimes: DataFrame, metrics: DataFrame, name: str, order: list[Column], policy: Policy) -> DataFrame:
    """Every candidate with its failed gates, and its rank among those that pass all: (name, ..., failed, eligible, rank, selected).

    ``sensitivities`` are those of :func:`sensitivity`; ``runtimes`` has
    samples, total, data, model and generation; ``metrics`` what ``order``
    needs. A candidate that one of them lacks fails by that. Ties are broken
    by name.
    """
    made = evaluate.runtime_projection(
        *[F.col(c) for c in ("total", "data", "model", "generation", "samples")],
        wanted=policy.wanted,
        reserve=policy.reserve,
        factor=policy.factor,
    )
    runs = runtimes.select(name, "samples", made["guarded"].alias("projected"))
    rows = metrics.join(sensitivities, name, "full").join(runs, name, "full")
    lacks = lambda ok: ~F.coalesce(ok, F.lit(False))
    failed = reasons(
        {
            "mean_delta": lacks(F.col("mean") > policy.least_mean_delta),
            "positive_fraction": lacks(F.col("positive") >= policy.least_positive),
            "too_few_samples": lacks(F.col("samples") >= policy.least_samples),
            "runtime": lacks(F.col("projected") <= policy.limit),
        }
    )
    out = evaluate.ranked(rows.withColumn("failed", failed), name, F.size("failed") == 0, order)
    return out.withColumn("selected", F.coalesce(F.col("rank") == 1, F.lit(False)))


def differing(made: DataFrame, again: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two selections has, with ``side``; none if they agree."""
    a, b = made.select(columns), again.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("again")))


def report_rules(reports: DataFrame, key: str, required: dict[str, Column], same: list[str]) -> dict[str, DataFrame]:
    """What breaks a cohort of reports, by rule: a contract that a report does not meet, a key twice, and fields in which reports differ."""
    rules = {name: reports.where(~F.coalesce(ok, F.lit(False))) for name, ok in required.items()}
    rules[f"repeated_{key}"] = reports.groupBy(key).count().where("count > 1")
    for field in same:
        rules[f"other_{field}"] = reports.agg(F.count_distinct(F.coalesce(F.col(field).cast("string"), F.lit(""))).alias("n")).where("n > 1")
    return rules


def pair_rules(a: DataFrame, b: DataFrame, key: str, same: list[str], donors: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """What breaks a pair of reports over the same keys, by rule.

    Keys of one alone, fields in which both differ for a key, and with donors
    (a column of ``b``, the column of ``a`` that it names) a row that is its
    own donor or a donor that isn't there.
    """
    x, y = (t.select(key, F.struct(*same).alias(s)) for t, s in ((a, "x"), (b, "y")))
    both = x.join(y, key, "full")
    rules = {"alone": both.where("x is null or y is null")}
    for field in same:
        rules[f"other_{field}"] = both.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col(f"x.{field}").eqNullSafe(F.col(f"y.{field}")))
    if donors is not None:
        donor, of = donors
        rules["own_donor"] = b.where(F.col(donor).eqNullSafe(F.col(key)))
        rules["unknown_donor"] = b.join(a.select(F.col(of).alias(donor)), donor, "left_anti")
    return rules


def metric_report(rows: DataFrame, domain: str, ranking: str, metrics: list[str]) -> DataFrame:
    """(scope, n, metrics): the sample-weighted mean of all, and the unweighted mean of the worst quarter of domains.

    A mean that is not finite is an error.
    """
    means = evaluate.domain_means(rows, [domain], metrics)
    overall = evaluate.weighted_overall(means, [], metrics).select(F.lit("overall").alias("scope"), "n", *metrics)
    worst = evaluate.worst_quartile(means, [], domain, ranking, metrics).select(
        F.lit("worst_quartile").alias("scope"), F.col("n_domains").alias("n"), *metrics
    )
    return overall.unionByName(worst)


def batch_means(batches: DataFrame, by: list[str], value: str, size: str) -> DataFrame:
    """(by, weighted, unweighted): a mean of batches' means by their sizes, as validation takes it, and one without, as training does."""
    return batches.groupBy(*by).agg(
        (F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("weighted"), F.avg(value).alias("unweighted")
    )


def scaled_budget(steps: Column, everything: Column, fold: Column) -> Column:
    """Update steps for all episodes, in proportion to a fold's."""
    return F.ceil(steps * everything / fold).cast("long")


def complete(stages: DataFrame, artifacts: DataFrame, stage: str, name: str) -> DataFrame:
    """(stage, wanted, found, complete) of stages (stage, name) and the artifacts (stage, name, bytes) that they left; empty ones don't count."""
    there = artifacts.where("bytes > 0").select(stage, name).distinct().withColumn("_there", F.lit(1))
    out = stages.select(stage, name).join(there, [stage, name], "left").groupBy(stage).agg(F.count("*").alias("wanted"), F.count("_there").alias("found"))
    return out.withColumn("complete", F.col("wanted") == F.col("found"))


def linked(records: DataFrame, key: str, parent: str, digest: str) -> DataFrame:
    """(key, status) of records that name another by key (``parent``) and digest (``parent_digest``): ok, root, unknown or other_digest."""
    known = records.select(F.col(key).alias(parent), F.col(digest).alias("_digest"))
    status = (
        F.when(F.col(parent).isNull(), "root")
        .when(F.col("_digest").isNull(), "unknown")
        .when(F.col("_digest") != F.col("parent_digest"), "other_digest")
        .otherwise("ok")
    )
    return records.join(known, parent, "left").select(key, status.alias("status"))
