"""Queries on nested reports: an order is a report, its line items the samples; faults are planted by the order's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import reports
from quern.plans.registry import query
from quern.tables import table

#: A rule, the orders that break it, and what is then shown; fixed for both the plan and its SQL.
PLANTED = {
    "schema_version": (31, "2"),
    "validation_scope": (37, "all"),
    "submission_kit_used": (41, "true"),
    "action_control": (43, "none"),
    "train_root": (47, "/data/Eval/train"),
    "checkpoint_contract_status": (53, "other"),
    "checkpoint_bytes": (59, "0"),
    "contract_stats_sha256": (61, "abc"),
    "alignment": (67, "causal <> late"),
    "validation_dataset_size": (71, "0"),
    "repository_overlap": (73, "r1"),
    "first_frame_hard_clamped": (79, None),
}
A, B = "a" * 64, "b" * 64


def _reports(spark, d, schema=reports.REPORT):
    # Three numbers a line go through the exchange; samples are made behind it.
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), "l_linenumber", "l_quantity").repartition("report")
    sample = F.struct(
        F.col("l_linenumber").cast("long").alias("dataset_index"),
        F.concat(F.lit("r"), (F.col("l_linenumber") % 3).cast("string")).alias("repository_id"),
        F.col("l_linenumber").cast("long").alias("episode_index"),
        F.struct(F.col("l_quantity").cast("double").alias("l1"), (1 / (F.col("l_quantity") + 1)).alias("ssim")).alias("metrics"),
    )
    # An order has some line items; a report is one document by its nature.
    rows = lines.groupBy("report").agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    written = F.when(F.col("report") % 101 == 0, F.concat("samples", F.slice("samples", 1, 1))).otherwise(F.col("samples"))
    rows = rows.withColumn("written", written)
    key, n = F.col("report"), F.size("samples")
    off = lambda name: key % PLANTED[name][0] == 0
    mean = lambda m, samples="samples": F.aggregate(F.col(samples)["metrics"][m], F.lit(0.0), lambda a, x: a + x) / F.size(samples)
    contract = lambda stats: F.struct(
        stats.alias("stats_sha256"), F.lit(A).alias("fold_fingerprint"), F.lit(B).alias("manifest_sha256"), F.lit(A).alias("fold_artifact_sha256"),
        F.lit(B).alias("config_sha256"), F.lit("causal").alias("alignment"), F.lit("f0").alias("fold_id"),
    )
    stats = F.when(off("contract_stats_sha256"), "abc").otherwise(A)
    provenance = F.struct(
        F.lit(False).alias("submission_kit_used"),
        F.when(off("action_control"), "none").otherwise("original").alias("action_control"),
        F.when(off("train_root"), "/data/Eval/train").otherwise("/data/train").alias("train_root"),
        contract(stats).alias("expected_contract"),
        contract(F.when(key % 83 == 0, B).otherwise(stats)).alias("checkpoint_contract"),
        F.when(off("checkpoint_contract_status"), "other").otherwise("matched").alias("checkpoint_contract_status"),
        F.struct(F.lit(A).alias("sha256"), F.when(off("checkpoint_bytes"), 0).otherwise(9).alias("bytes")).alias("checkpoint"),
        F.lit(B).alias("ordered_config_sha256"),
        F.when(off("alignment"), "late").otherwise("causal").alias("action_alignment"),
        F.array(F.struct(F.lit("c.yaml").alias("path"), F.lit(A).alias("sha256"), F.lit(1).alias("bytes"))).alias("configs"),
        F.struct(
            F.lit(2).alias("expected_main"), F.lit(2).alias("loaded_main"), F.lit(2).alias("expected_ema"), F.lit(2).alias("loaded_ema"),
            F.lit("full").alias("ema_status"), F.array().cast("array<string>").alias("incompatible"),
        ).alias("loaded"),
        F.array(F.lit("r1"), F.lit("r2")).alias("train_repository_ids"),
        F.when(off("repository_overlap"), F.array(F.lit("r1"), F.lit("v"))).otherwise(F.array(F.lit("v"))).alias("validation_repository_ids"),
        (key % 2 == 0).alias("validation_is_checkpoint_pristine"),
        F.when(off("validation_dataset_size"), 0).otherwise(n).alias("validation_dataset_size"),
        F.when(key % 997 == 5, 8).otherwise(7).alias("selection_seed"),
        F.when(key % 89 == 0, F.lit(None)).otherwise(F.lit("unit")).alias("metric_space"),
        F.when(~off("first_frame_hard_clamped"), True).alias("first_frame_hard_clamped"),
    )
    # Off by one from the samples that are written, as one of them more can move their mean by one as well.
    l1 = F.when(key % 103 == 0, mean("l1", "written") + 1).otherwise(mean("l1"))
    document = F.struct(
        F.when(off("schema_version"), 2).otherwise(1).alias("schema_version"),
        F.when(off("validation_scope"), "all").otherwise("held_out_train_only").alias("validation_scope"),
        off("submission_kit_used").alias("submission_kit_used"),
        n.alias("sample_limit"),
        n.alias("sample_count"),
        F.col("written").alias("samples"),
        reports.fingerprint(F.col("samples")).alias("selection_fingerprint"),
        F.struct(
            F.struct(l1.alias("l1"), mean("ssim").alias("ssim")).alias("overall"), F.lit("l1").alias("ranking_metric")
        ).alias("metrics"),
        provenance.alias("provenance"),
    )
    made = rows.select("report", (key % 500).alias("cohort"), F.to_json(document).alias("text"))
    return reports.parsed_reports(made, "text", schema)


def _planted_sql() -> str:
    parts = []
    for rule, (n, value) in PLANTED.items():
        more = " AND report % 2 = 1" if rule == "repository_overlap" else ""
        parts.append(f"SELECT report, '{rule}' AS rule, {'NULL' if value is None else repr(value)} AS value FROM o WHERE report % {n} = 0{more}")
    return "\nUNION ALL ".join(parts)


@query(f"""WITH l AS (SELECT l_orderkey AS report, l_linenumber AS i, l_quantity::DOUBLE AS q FROM lineitem),
o AS (SELECT report, count(*) AS n, count(DISTINCT i) AS places, avg(q) AS mean FROM l GROUP BY report),
b AS ({_planted_sql()}
UNION ALL SELECT report, 'checkpoint_contract', '' FROM o WHERE report % 83 = 0
UNION ALL SELECT report, 'sample_count', (n + 1)::VARCHAR FROM o WHERE report % 101 = 0
UNION ALL SELECT report, 'repeated_dataset_index', (n + (report % 101 = 0)::INT - places)::VARCHAR FROM o WHERE n + (report % 101 = 0)::INT > places
UNION ALL SELECT report, 'selection_fingerprint', '' FROM o WHERE report % 101 = 0
UNION ALL SELECT report, 'l1_mean', '' FROM o JOIN (SELECT l_orderkey AS report, arg_min(q, struct_pack(a := i, q := q)) AS first FROM (SELECT l_orderkey, l_linenumber AS i, l_quantity::DOUBLE AS q FROM lineitem) GROUP BY 1) USING (report)
  WHERE report % 103 = 0 OR report % 101 = 0 AND first <> mean
UNION ALL SELECT report, 'ssim_mean', '' FROM (SELECT l_orderkey AS report, avg(1 / (l_quantity + 1)) AS m, arg_min(1 / (l_quantity + 1), struct_pack(a := l_linenumber, q := l_quantity)) AS first FROM lineitem GROUP BY 1) WHERE report % 101 = 0 AND abs(first - m) > 1e-9)
SELECT report, rule, 'error' AS severity, value FROM b""")
def report_rules(spark, d):
    """Which orders' reports break which rule; digests and means are left out of what is shown."""
    found = reports.broken(_reports(spark, d), "report", reports.contract_rules(F.col("r"), "original"))
    plain = F.col("rule").isin("checkpoint_contract", "selection_fingerprint", "l1_mean", "ssim_mean")
    return found.withColumn("value", F.when(plain, "").otherwise(F.col("value")))


@query("""WITH o AS (SELECT l_orderkey AS report, l_orderkey % 500 AS cohort, count(*) AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT cohort, 'sample_limit' AS field, '{"x":' || n || '}' AS v FROM o UNION ALL SELECT cohort, 'selection_seed', CASE WHEN report % 997 = 5 THEN '{"x":8}' ELSE '{"x":7}' END FROM o
  UNION ALL SELECT cohort, 'metric_space', CASE WHEN report % 89 = 0 THEN '{}' ELSE '{"x":"unit"}' END FROM o)
SELECT cohort, field, count(*) AS reports, min(v) AS least, max(v) AS most FROM f GROUP BY cohort, field HAVING min(v) <> max(v)""")
def report_cohorts(spark, d):
    """Fields in which the reports of a cohort differ although they must not."""
    rows = _reports(spark, d, reports.COHORT)
    return reports.differing_cohorts(rows, "cohort", reports.cohort_fields(F.col("r")))
