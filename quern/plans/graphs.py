"""Queries on components, leakage units and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import folds, graph
from quern.plans.registry import query
from quern.storage import checkpointed
from quern.tables import table

#: Customers with balances in one of two overlapping grids of cells are linked.
CELLS = "c AS (SELECT c_custkey, floor(c_acctbal / 2)::BIGINT AS a, floor((c_acctbal + 1) / 2)::BIGINT AS b FROM customer)"


def _cells(spark, d):
    cell = lambda x: F.floor(x / 2).cast("long")
    return table(spark, d, "customer").select("c_custkey", cell(F.col("c_acctbal")).alias("a"), cell(F.col("c_acctbal") + 1).alias("b"))


REACH = f"""{CELLS}, n AS (SELECT DISTINCT 'a' || a AS x, 'b' || b AS y FROM c), u AS (SELECT x, y FROM n UNION ALL SELECT y, x FROM n),
reach(node, other) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM reach r JOIN u ON u.x = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {REACH} SELECT node, root FROM roots")
def components(spark, d):
    cells = _cells(spark, d)
    return graph.components(cells.select(F.concat(F.lit("a"), "a").alias("a"), F.concat(F.lit("b"), "b").alias("b")))


UNITS = f"""{REACH}, o AS (SELECT o_custkey AS c_custkey, count(*) AS frames FROM orders GROUP BY 1),
j AS (SELECT root, a::VARCHAR AS owner, b::VARCHAR AS grp, coalesce(frames, 0) AS frames FROM c LEFT JOIN o USING (c_custkey) JOIN roots ON node = 'a' || a),
g AS (SELECT root, count(*) AS episode_count, sum(frames)::BIGINT AS frame_count, list_sort(list(DISTINCT owner)) AS owners, list_sort(list(DISTINCT grp)) AS grps FROM j GROUP BY root),
i AS (SELECT *, 'leakage-unit:' || substr(sha256('{{"owners":["' || array_to_string(owners, '","') || '"],"validation_groups":["' || array_to_string(grps, '","') || '"]}}'), 1, 20) AS unit_id FROM g)"""


def _unit_members(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("frames"))
    rows = _cells(spark, d).join(orders, "c_custkey", "left")
    return checkpointed(graph.unit_members(rows, F.col("a"), F.col("b"), F.coalesce("frames", F.lit(0))))


@query(f"""WITH RECURSIVE {UNITS}
SELECT unit_id, array_to_string(owners, ',') AS owners, array_to_string(grps, ',') AS groups, len(owners) AS n_owners, len(grps) AS n_groups, episode_count, frame_count FROM i""")
def leakage_units(spark, d):
    lists = [F.array_join(c, ",").alias(c) for c in ("owners", "groups")]
    return graph.leakage_units(_unit_members(spark, d)).select("unit_id", *lists, "n_owners", "n_groups", "episode_count", "frame_count")


@query(f"WITH RECURSIVE {UNITS} SELECT unit_id, 'owner' AS kind, unnest(owners) AS name FROM i UNION ALL SELECT unit_id, 'group', unnest(grps) FROM i")
def leakage_members(spark, d):
    """The owners and groups of each unit, a row for each."""
    members = _unit_members(spark, d)
    names = F.array(F.struct(F.lit("owner").alias("kind"), F.col("owner").alias("name")), F.struct(F.lit("group").alias("kind"), F.col("grp").alias("name")))
    return members.select("root", F.inline(names)).distinct().join(graph.leakage_units(members).select("root", "unit_id"), "root").drop("root")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT sha256(text) AS sha, source FROM documents), f AS (SELECT sha, min(source) AS a FROM d GROUP BY sha),
e AS (SELECT DISTINCT a AS x, source AS y FROM d JOIN f USING (sha)), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(node, other) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM reach r JOIN u ON u.x = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), ids AS (SELECT root, list_sort(list(node)) AS names FROM roots GROUP BY root)
SELECT node AS source, CASE WHEN len(names) > 1 THEN 'linked-repos:' || substr(sha256(array_to_string(names, chr(10))), 1, 20) ELSE 'repo:' || node END AS component
FROM roots JOIN ids USING (root)""")
def repo_components(spark, d):
    docs = table(spark, d, "documents").select(keys.digest(F.col("text")).alias("sha"), "source")
    return graph.linked_repositories(docs, "sha", "source")


def holdout_sql(source: str, key: str, seed: str, threshold: str) -> str:
    return f"""WITH s AS (SELECT DISTINCT {key}, substr(sha256('{seed}:' || {key}), 1, 16) AS score FROM {source}),
p AS (SELECT *, score < '{threshold}' AS below, row_number() OVER (ORDER BY score, {key}) AS rn, count(*) OVER () AS n,
  count(*) FILTER (score < '{threshold}') OVER () AS held FROM s)
SELECT {key}, score, CASE WHEN held = 0 THEN rn = 1 WHEN held = n THEN rn < n ELSE below END AS is_val FROM p"""


@query(f"""WITH h AS ({holdout_sql("customer", "c_nationkey", "13", keys.threshold_hex(0.2))})
SELECT c_custkey, c_nationkey, score, is_val FROM customer JOIN h USING (c_nationkey)""")
def hash_holdout(spark, d):
    """Every customer with the side of its nation."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    held = folds.group_holdout(customers, "c_nationkey", "13", 0.2)
    return customers.join(held, "c_nationkey").select("c_custkey", "c_nationkey", "score", "is_val")


@query(holdout_sql("region", "r_name", "13", keys.threshold_hex(0.0001)))
def holdout_repair(spark, d):
    return folds.group_holdout(table(spark, d, "region"), "r_name", "13", 0.0001)


@query("""WITH f AS (SELECT 'leave_' || c_nationkey AS fold_id, c_custkey FROM customer)
SELECT c_custkey, count(*) AS times, count(*) = 1 AS once FROM f GROUP BY c_custkey""")
def loo_coverage(spark, d):
    held = table(spark, d, "customer").select(F.concat(F.lit("leave_"), "c_nationkey").alias("fold_id"), "c_custkey")
    return folds.coverage_of_folds(held, "c_custkey")
