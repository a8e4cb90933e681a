"""Metrics by domain, gates and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.sampling import numbered_in_groups


def domain_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Count and means of each domain; a mean that is not finite raises an error."""

    def mean(m: str) -> Column:
        x = F.avg(m)
        bad = F.raise_error(F.lit(f"{m} is not finite"))
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), bad).otherwise(x).alias(m)

    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[mean(m) for m in metrics])


def weighted_overall(means: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means over samples, from the means of domains."""
    n = F.sum("n")
    return means.groupBy(*by).agg(n.alias("n"), *[(F.sum(F.col(m) * F.col("n")) / n).alias(m) for m in metrics])


def worst_quartile(means: DataFrame, by: list[str], domain: str, ranking: str, metrics: list[str], share: float = 0.25) -> DataFrame:
    """The unweighted mean of each metric over the domains with the largest ranking metric, a share of them and one at least."""
    rows = means.withColumn("_down", -F.col(ranking))
    placed = numbered_in_groups(rows, by, ["_down", domain], "rn", "domains")
    worst = placed.where(F.col("rn") <= F.greatest(F.ceil(F.col("domains") * share), F.lit(1)))
    return worst.groupBy(*by).agg(F.count("*").alias("n_domains"), *[F.avg(m).alias(m) for m in metrics])


def ranked(candidates: DataFrame, name: str, eligible: Column, order: list[Column]) -> DataFrame:
    """Candidates with their rank among the eligible ones by several metrics, then name; null for the others."""
    marked = candidates.withColumn("eligible", eligible)
    rank = F.row_number().over(Window.partitionBy("eligible").orderBy(*order, name))
    return marked.withColumn("rank", F.when(F.col("eligible"), rank))


def runtime_projection(
    total: Column, data: Column, model: Column, generation: Column, n: Column, wanted: int, reserve: float, factor: float
) -> dict[str, Column]:
    """Seconds that a full run takes, by what some samples took; null where the record contradicts itself."""
    setup = data + model
    per = F.greatest(total - setup, generation) / n
    raw = setup + wanted * per
    fits = (n > 0) & (total >= setup) & (generation <= total * (1 + 1e-9))
    return {"per_sample": F.when(fits, per), "raw": F.when(fits, raw), "guarded": F.when(fits, reserve + factor * raw)}


def assertions(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations, ok): each rule is a frame of what breaks it."""
    out = None
    for name, broken in rules.items():
        one = broken.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations", (F.col("violations") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def require_all(report: DataFrame) -> None:
    """Raise if a rule of a report is broken."""
    broken = [r.rule for r in report.where(~F.col("ok")).collect()]
    if broken:
        raise ValueError(f"broken: {', '.join(broken)}")
