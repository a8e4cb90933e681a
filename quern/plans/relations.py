"""Queries on joins, coverage and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import relations, sampling
from quern.plans.registry import query
from quern.tables import table


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
  CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'both' END AS side
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_join(spark, d):
    return relations.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_enrich(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    return (
        o.join(c, o.o_custkey == c.c_custkey, "left")
        .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
        .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
        .select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")
    )


@query("""WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - item_id, array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark WHERE item_id % 5 = 0),
hit AS (SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN b ON contains(d.text, b.text))
SELECT source, count(DISTINCT doc_id) AS leaked_docs, count(DISTINCT item_id) AS leaked_items
FROM hit JOIN documents USING (doc_id) GROUP BY source""")
def anti_semi_leakage(spark, d):
    """Documents that hold passages of the benchmark, or the first two words of one in five."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark")
    two = F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text")
    short = items.where("item_id % 5 = 0").select((-1 - F.col("item_id")).alias("item_id"), two)
    hits = relations.contained_in(docs.select("doc_id", "text"), items.select("item_id", "text").unionByName(short))
    return (
        hits.join(docs.select("doc_id", "source"), "doc_id")
        .groupBy("source")
        .agg(F.count_distinct("doc_id").alias("leaked_docs"), F.count_distinct("item_id").alias("leaked_items"))
    )


SIDES = """s AS (SELECT *, CASE WHEN substr(sha256('3:' || c_custkey), 1, 16) < '3333333333333000' THEN 'val' ELSE 'train' END AS side FROM customer)"""


def _sides(spark, d):
    held = keys.score_hex("3", F.col("c_custkey").cast("string")) < keys.threshold_hex(0.2)
    return table(spark, d, "customer").withColumn("side", F.when(held, "val").otherwise("train"))


@query(f"""WITH {SIDES},
a AS (SELECT 'nation' AS scope, c_nationkey::VARCHAR AS k, side FROM s UNION ALL SELECT 'segment', c_mktsegment, side FROM s
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, side FROM s)
SELECT scope, count(*) FILTER (sides > 1) AS overlap, count(*) AS keys
FROM (SELECT scope, k, count(DISTINCT side) AS sides FROM a GROUP BY scope, k) GROUP BY scope""")
def overlap_audit(spark, d):
    rows = _sides(spark, d)
    out = None
    for scope, key in (("nation", "c_nationkey"), ("segment", "c_mktsegment"), ("customer", "c_custkey")):
        one = relations.overlap(rows, key, "side").select(F.lit(scope).alias("scope"), "overlap", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SIDES}, o AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT side, count(*) AS customers, sum(coalesce(n_orders, 0))::BIGINT AS orders, count(DISTINCT c_nationkey) AS nations,
  count(DISTINCT c_mktsegment) AS segments, round(count(*) / (SELECT count(*) FROM customer), 6) AS fraction
FROM s LEFT JOIN o USING (c_custkey) GROUP BY side""")
def fold_summary(spark, d):
    customers = _sides(spark, d)
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    total = customers.agg(F.count("*").alias("total"))
    sides = customers.join(orders, "c_custkey", "left").groupBy("side").agg(
        F.count("*").alias("customers"),
        F.sum(F.coalesce("n_orders", F.lit(0))).cast("long").alias("orders"),
        F.count_distinct("c_nationkey").alias("nations"),
        F.count_distinct("c_mktsegment").alias("segments"),
    )
    return sides.join(F.broadcast(total)).withColumn("fraction", F.round(F.col("customers") / F.col("total"), 6)).drop("total")


@query("""SELECT n_nationkey, 'c' AS side FROM (SELECT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT
  SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT n_nationkey, 's' FROM (SELECT s_nationkey AS n_nationkey FROM supplier WHERE s_acctbal > 9000 EXCEPT
  SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def sym_diff(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    b = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    out = relations.symmetric_difference(a, b)
    return out.withColumn("side", F.when(F.col("side") == "a", "c").otherwise("s"))


ROBIN = """r AS (SELECT doc_id, source, substr(sha256('5:' || source), 1, 16) AS group_score,
  row_number() OVER (PARTITION BY source ORDER BY substr(sha256('5:' || doc_id || chr(9) || source), 1, 16), doc_id) - 1 AS depth FROM documents)"""


@query(f"WITH {ROBIN} SELECT doc_id, source, depth::INT AS depth FROM r ORDER BY depth, group_score, source LIMIT 64")
def round_robin_sample(spark, d):
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), "source")
    rows = table(spark, d, "documents").select("doc_id", "source")
    return sampling.round_robin(rows, "source", "5", line, "doc_id", 64).select("doc_id", "source", "depth")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY substr(sha256('9:' || doc_id), 1, 16), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT a.doc_id, b.doc_id AS donor FROM r a JOIN r b ON b.rn = a.rn % a.n + 1""")
def ring_donor(spark, d):
    rows = table(spark, d, "documents").select("doc_id", keys.score_hex("9", F.col("doc_id").cast("string")).alias("s"))
    return sampling.ring_donor(rows, ["s", "doc_id"], "doc_id", "donor").select("doc_id", "donor")


@query("SELECT doc_id, lang, round(pow(count(*) OVER (PARTITION BY lang), -0.5), 9) AS weight FROM documents")
def owner_weight(spark, d):
    out = sampling.frequency_weight(table(spark, d, "documents").select("doc_id", "lang"), "lang", 0.5)
    return out.select("doc_id", "lang", F.round("weight", 9).alias("weight"))


@query()
def weighted_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    weights = sampling.frequency_weight(rows, "lang", 0.5)
    return sampling.weighted_draws(weights, "doc_id", F.col("weight"), 500, "11", 0).select("draw", F.col("key").alias("doc_id"))
