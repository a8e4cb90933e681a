"""Queries on folds, splits and joins that must cover their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import keys
from quern.operators import partitions, relations
from quern.operators.evaluate import assertions
from quern.plans.registry import query
from quern.tables import table

SCOPES = {"owner": "owner", "validation_group": "segment", "repository": "repository"}
T20 = keys.threshold_hex(0.2)

#: Customers as episodes. Folds 0 to 2 hold nations out, 3 single customers, and 4 is spoiled: a part is missing, some are on both sides.
CUSTOMERS = f"""e AS (SELECT c_custkey AS key, c_nationkey AS owner, c_mktsegment AS segment, c_custkey % 40 AS repository FROM customer),
f AS (SELECT s AS fold_id, key, CASE WHEN substr(sha256(s || ':' || CASE WHEN s < 3 THEN owner ELSE key END), 1, 16) < '{T20}'
    THEN 'validation' ELSE 'train' END AS side FROM e, range(0, 5) AS r(s)),
m AS (SELECT * FROM f WHERE fold_id < 4 OR key % 3 > 0 UNION ALL SELECT 4, key, 'train' FROM e WHERE key % 7 = 0
  UNION ALL SELECT 4, -key, 'validation' FROM e WHERE key % 11 = 0)"""


def _episodes(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("key"), F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("segment"), (key % 40).alias("repository")
    )


def _members(spark, d):
    e = _episodes(spark, d).withColumn("fold_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    unit = F.when(F.col("fold_id") < 3, F.col("owner").cast("string")).otherwise(F.col("key").cast("string"))
    side = F.when(keys.score_hex(F.col("fold_id").cast("string"), unit) < T20, "validation").otherwise("train")
    rows = e.select("fold_id", "key", side.alias("side"))
    last = e.where("fold_id = 4")
    return (
        rows.where("fold_id < 4 or key % 3 > 0")
        .unionByName(last.where("key % 7 = 0").select("fold_id", "key", F.lit("train").alias("side")))
        .unionByName(last.where("key % 11 = 0").select("fold_id", (-F.col("key")).alias("key"), F.lit("validation").alias("side")))
    )


def _overlap(scope: str, column: str) -> str:
    return f"""(SELECT fold_id, count(*) FILTER (sides > 1) AS {scope}_overlap_count FROM (SELECT fold_id, {column}, count(DISTINCT side) AS sides
  FROM m JOIN e USING (key) GROUP BY ALL) GROUP BY fold_id) AS {scope}"""


AUDIT = f"""{CUSTOMERS},
k AS (SELECT fold_id, key, count(*) FILTER (side = 'train') AS t, count(*) FILTER (side = 'validation') AS v FROM m GROUP BY ALL),
a AS (SELECT fold_id, bool_or(t > 0) AS train_nonempty, bool_or(v > 0) AS validation_nonempty,
  sum(greatest(t - 1, 0))::BIGINT AS duplicate_train_count, sum(greatest(v - 1, 0))::BIGINT AS duplicate_validation_count,
  count(*) FILTER (t > 0 AND v > 0) AS episode_overlap_count, count(*) FILTER (e.key IS NULL) AS unknown_episode_count,
  (SELECT count(*) FROM e) - count(e.key) AS missing_episode_count
  FROM k LEFT JOIN e USING (key) GROUP BY fold_id),
audit AS (SELECT *, missing_episode_count = 0 AND unknown_episode_count = 0 AS complete_partition,
  train_nonempty AND validation_nonempty AND missing_episode_count + unknown_episode_count + duplicate_train_count + duplicate_validation_count
    + episode_overlap_count + owner_overlap_count + validation_group_overlap_count + repository_overlap_count = 0 AS passed
  FROM a JOIN {_overlap("owner", "owner")} USING (fold_id) JOIN {_overlap("validation_group", "segment")} USING (fold_id)
  JOIN {_overlap("repository", "repository")} USING (fold_id))"""


@query(f"WITH {AUDIT} SELECT * FROM audit")
def fold_audit(spark, d):
    return partitions.fold_audit(_members(spark, d), _episodes(spark, d), "key", SCOPES)


@query(f"""WITH {AUDIT}, v AS (SELECT fold_id, list_sort(list(DISTINCT key)) AS ids FROM m WHERE side = 'validation' GROUP BY fold_id),
o AS (SELECT key, count(*) FILTER (side = 'validation') AS times FROM m WHERE fold_id < 3 GROUP BY key)
SELECT 'failed_fold' AS rule, count(*) AS violations, count(*) = 0 AS ok FROM audit WHERE NOT passed
UNION ALL SELECT 'equal_validation_sets', count(*), count(*) = 0 FROM (SELECT ids FROM v GROUP BY ids HAVING count(*) > 1)
UNION ALL SELECT 'not_held_out_once', count(*), count(*) = 0 FROM o WHERE times <> 1""")
def fold_collection_audit(spark, d):
    listed = _members(spark, d)
    audits = partitions.fold_audit(listed, _episodes(spark, d), "key", SCOPES)
    return assertions(partitions.collection_rules(listed, audits, F.col("fold_id") < 3))


@query(f"""WITH {CUSTOMERS}, u AS (SELECT DISTINCT owner FROM e WHERE substr(sha256('17:' || owner), 1, 16) < '{T20}')
SELECT key, owner, CASE WHEN u.owner IS NULL THEN 'train' ELSE 'validation' END AS side FROM e LEFT JOIN u USING (owner)""")
def fold_materialized(spark, d):
    """The complement of the held-out units is what is trained on."""
    e = _episodes(spark, d)
    held = keys.score_hex("17", F.col("owner").cast("string")) < T20
    return partitions.fold_from_units(e.select("owner").distinct(), e, "owner", held).select("key", "owner", "side")


@query(f"""WITH {CUSTOMERS} SELECT fold_id, side, segment AS value FROM m JOIN e USING (key) GROUP BY ALL""")
def partition_values(spark, d):
    rows = _members(spark, d).join(_episodes(spark, d), "key")
    return partitions.partition_values(rows, "segment")


@query(f"""WITH {CUSTOMERS}, w AS (SELECT key FROM m WHERE fold_id = 0 AND side = 'validation')
SELECT 'fold' AS told_by, key FROM e SEMI JOIN w USING (key)
UNION ALL SELECT 'groups', key FROM e WHERE segment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'rule', key FROM e WHERE substr(sha256('5:' || key), 1, 16) < '{T20}'
UNION ALL SELECT 'rule_train', key FROM e WHERE substr(sha256('5:' || key), 1, 16) >= '{T20}'
UNION ALL SELECT 'all', key FROM e""")
def split_selector(spark, d):
    e, fold = _episodes(spark, d), _members(spark, d).where("fold_id = 0")
    rule = keys.score_hex("5", F.col("key").cast("string")) < T20
    made = {
        "fold": partitions.selected(e, "validation", key="key", fold=fold),
        "groups": partitions.selected(e, "validation", key="key", groups=("segment", ["BUILDING", "MACHINERY"])),
        "rule": partitions.selected(e, "validation", key="key", held=rule),
        "rule_train": partitions.selected(e, "train", key="key", held=rule),
        "all": partitions.selected(e, "all", key="key"),
    }
    out = None
    for name, rows in made.items():
        one = rows.select(F.lit(name).alias("told_by"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH k AS (SELECT c_custkey AS key, c_nationkey % 10 = c_custkey % 10 AS val FROM customer WHERE c_custkey % 13 > 0 UNION ALL SELECT c_custkey, c_nationkey % 10 = c_custkey % 10 FROM customer WHERE c_custkey % 29 = 1 AND c_custkey % 13 > 0),
l AS (SELECT DISTINCT o_custkey AS key, o_custkey % 40 AS repository FROM orders),
j AS (SELECT k.key AS a, l.key AS b, val, repository FROM (SELECT DISTINCT key, val FROM k) k FULL JOIN l ON k.key = l.key)
SELECT 'missing' AS rule, count(*) AS violations, count(*) = 0 AS ok FROM j WHERE b IS NULL
UNION ALL SELECT 'extra', count(*), count(*) = 0 FROM j WHERE a IS NULL
UNION ALL SELECT 'listed_twice', count(*), count(*) = 0 FROM (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
UNION ALL SELECT 'straddling', count(*), count(*) = 0 FROM (SELECT repository FROM j WHERE a = b GROUP BY repository HAVING count(DISTINCT val) > 1)""")
def exact_coverage(spark, d):
    """Keys of a fold against the live episodes: both must be the same, and no repository on both sides."""
    key = F.col("c_custkey")
    fold = table(spark, d, "customer").where("c_custkey % 13 > 0").select(key.alias("key"), (F.col("c_nationkey") % 10 == key % 10).alias("val"))
    fold = fold.unionByName(fold.where("key % 29 = 1"))  # listed twice
    live = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_custkey") % 40).alias("repository")).distinct()
    return assertions(relations.coverage_rules(fold, live, "key", side="val", group="repository"))


@query("""SELECT d.doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND coalesce(l.quality, 0) = 1)""")
def included_join(spark, d):
    """Episodes whose manifest row is included; one without a row is not."""
    rows = table(spark, d, "labels").withColumn("include", F.col("quality") == 1)
    return relations.included(table(spark, d, "documents").select("doc_id", "source"), rows, "doc_id", F.col("include"))


@query("""WITH v AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0), l AS (SELECT doc_id, quality = 1 AND toxic = 0 AS include,
  array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS reasons FROM labels)
SELECT v.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN include THEN 'usable' ELSE 'excluded' END AS status, coalesce(reasons, '') AS reasons
FROM v LEFT JOIN l USING (doc_id)""")
def official_validation(spark, d):
    """Wanted keys against a manifest: usable, excluded and why, or unknown to it."""
    from quern.operators.quality import reasons

    manifest = table(spark, d, "labels").select(
        "doc_id",
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("include"),
        reasons({"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}).alias("reasons"),
    )
    wanted = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id")
    out = relations.against_manifest(wanted, manifest, "doc_id", "include", "reasons")
    return out.select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_suppkey AS k, sum(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT k, round(b.m - a.m, 2) AS delta FROM a JOIN b USING (k)""")
def paired_reports(spark, d):
    """Two reports over the same keys; a key that only one has is an error."""
    lines = table(spark, d, "lineitem")
    a, b = (
        lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("m")) for f in "RA"
    )
    return relations.paired(a, b, "k", "m").select("k", F.round(F.col("m_b") - F.col("m_a"), 2).alias("delta"))


@query("""WITH c AS (SELECT n_nationkey AS key, n_name FROM nation WHERE n_nationkey % 6 > 0), r AS (SELECT s_nationkey AS key, count(*) AS runs FROM supplier GROUP BY 1)
SELECT coalesce(c.key, r.key) AS key, n_name, coalesce(runs, 0) AS runs,
  CASE WHEN r.key IS NULL THEN 'missing' WHEN c.key IS NULL THEN 'extra' WHEN runs > 1 THEN 'repeated' ELSE 'ok' END AS status FROM c FULL JOIN r USING (key)""")
def gate_runs(spark, d):
    """Candidates against their runs: each must have one, and no run stands alone."""
    c = table(spark, d, "nation").where("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("key"), "n_name")
    return relations.with_runs(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), "key").select("key", "n_name", "runs", "status")


@query("""WITH d AS (SELECT source, list_sort(list(doc_id)) AS ids, count(*) AS n FROM documents GROUP BY source),
l AS (SELECT source, list_sort(list(l.doc_id)) AS ids, count(*) AS labels FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE source LIKE '%1'
    AND doc_id NOT IN (SELECT doc_id FROM labels)) l JOIN documents USING (doc_id) GROUP BY source)
SELECT source, n, coalesce(labels, 0) AS labels, coalesce(d.ids = l.ids, false) AS same_set FROM d LEFT JOIN l USING (source)""")
def donor_set_equality(spark, d):
    """Whether two tables have the same keys in each group; in some sources the labels are made up to be all of them."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    own = table(spark, d, "labels").select("doc_id")
    more = docs.where("source like '%1'").select("doc_id").join(own, "doc_id", "left_anti")
    labelled = own.unionByName(more).join(docs, "doc_id")
    return relations.same_sets(docs, labelled, "source", "doc_id").select("source", F.col("n_a").alias("n"), F.col("n_b").alias("labels"), "same_set")


@query("""WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(length(text) ORDER BY turn) AS t, list(turn ORDER BY turn) AS i FROM conversations GROUP BY conv_id)
SELECT conv_id, len(r)::INT AS n, i = range(0, len(r)) AS in_order, r = [CASE x % 2 WHEN 0 THEN 'user' ELSE 'assistant' END FOR x IN range(0, len(r))] AS alternate,
  list_bool_and([x > 0 FOR x IN t]) AS nonempty FROM a""")
def ordered_evidence(spark, d):
    """Evidence of each conversation in the order of turns, each place held against what is expected there."""
    at = F.col("place") - 1
    rows = relations.placed(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    role = F.when(at % 2 == 0, "user").otherwise("assistant")
    every = lambda x: F.every(F.coalesce(x, F.lit(False)))
    return rows.groupBy("conv_id").agg(
        F.count("*").cast("int").alias("n"),
        every(F.col("turn") == at).alias("in_order"),
        every(F.col("role") == role).alias("alternate"),
        every(F.length("text") > 0).alias("nonempty"),
    )


@query("""WITH t AS (SELECT 'documents' AS source, doc_id AS id, doc_id::DOUBLE AS o, doc_id % 5 AS v FROM documents UNION ALL SELECT 'labels', doc_id, doc_id, doc_id % 5 FROM labels
  UNION ALL SELECT 'embeddings', vec_id, CASE WHEN vec_id % 30 = 4 THEN vec_id + 1.5 ELSE vec_id END, vec_id % 5 FROM embeddings
  UNION ALL SELECT 'pages', page_id, page_id, page_id % 5 + (page_id % 37 = 0)::INT FROM pages),
p AS (SELECT *, id // 10 AS shelf, row_number() OVER (PARTITION BY source, id // 10 ORDER BY o) AS place FROM t),
e AS (SELECT * FROM p WHERE source = 'documents'), s AS (SELECT unnest(['labels', 'embeddings', 'pages']) AS source),
w AS (SELECT s.source, e.shelf, e.id, e.place, e.v FROM e, s), h AS (SELECT * FROM p WHERE source <> 'documents'),
j AS (SELECT coalesce(w.source, h.source) AS source, coalesce(w.shelf, h.shelf) AS shelf, coalesce(w.id, h.id) AS id, w.place AS expected_place, h.place AS place,
  CASE WHEN h.place IS NULL THEN 'missing' WHEN w.place IS NULL THEN 'extra' ELSE
    concat_ws('+', CASE WHEN w.place <> h.place THEN 'misplaced' END, CASE WHEN w.v <> h.v THEN 'changed' END) END AS status
  FROM w FULL JOIN h ON w.source = h.source AND w.id = h.id)
SELECT * FROM j WHERE status <> ''""")
def evidence_order(spark, d):
    """Labels, embeddings and pages against the documents of the same ids, ten to a shelf, in exact order; some are moved, and some changed."""
    shelf = F.floor(F.col("id") / 10).alias("shelf")

    def made(name, key, order, value):
        rows = table(spark, d, name).select(F.col(key).alias("id"), order.cast("double").alias("o"), value.cast("long").alias("v"))
        return relations.placed(rows.select(shelf, "id", "o", "v"), ["shelf"], ["o"])

    doc, vec, page = F.col("doc_id"), F.col("vec_id"), F.col("page_id")
    others = {
        "labels": made("labels", "doc_id", doc, doc % 5),
        "embeddings": made("embeddings", "vec_id", F.when(vec % 30 == 4, vec + 1.5).otherwise(vec), vec % 5),
        "pages": made("pages", "page_id", page, page % 5 + (page % 37 == 0).cast("int")),
    }
    return relations.sequence_evidence(made("documents", "doc_id", doc, doc % 5), others, ["shelf"], "id", ["v"])
